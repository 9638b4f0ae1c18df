"""Personal data: generators propose spans, boosted trees and thresholds choose.

DataFrame functions only. Four kinds have fixed patterns and checks (mail and IP
addresses, card and phone numbers) and always count. Further generators propose
spans generously, and overlap each other: access keys, long hexadecimal or mixed
tokens, values after words like "password", account numbers, digit groups. Boosted
trees score each proposal by its form and by what stands around it; a threshold
for each generator, set on rows the trees have not seen, decides; overlapping
choices are taken greedily, best first. A proposal goes to the end of its value, however
long; form and overlaps are judged by its head. The trees learn from generated examples (fixed seed,
bounded number) that pass through the same expressions as the corpus.

Patterns never scan a run of characters twice: quantifiers are possessive, and a
match cannot start inside a run whose start has failed. Places and overlaps of a
text's spans take time in proportion to their number (and to the square of that of a
cluster of spans that overlap): running sums and maxima are made in chunks.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit

#: Fixed patterns of the four base kinds, in order of the result.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
OCTET = "(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"

#: Generators by kind; what must be in a text for the pattern to be tried.
GENERATORS = {
    "account": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,}+(?:\x20?[A-Z0-9]{1,3})?+", "[0-9]"),
    "contact": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]?at[\])]?\x20?[A-Za-z0-9-]++\x20?[\[(]?dot[\])]?\x20?[A-Za-z]{2,}+", "dot"),
    "credential": (r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\x20{0,2}[=:]\x20{0,2}[\"']?[^\s\"']{6,}+", "[=:]"),
    "key": (r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+", "[0-9]"),
    "number": (r"(?<![0-9+.])\(?[0-9](?:[().\x20-]{0,2}[0-9]){6,}+", "[0-9]"),
    "token": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", "[0-9]"),
}
#: Characters of a value by which it is judged. They choose, they do not cut.
HEADS = {"account": 64, "contact": 128, "credential": 128, "key": 64, "number": 25, "token": 512}
KINDS = [*BASE, *GENERATORS]
AROUND = 24
CHUNK = 128
EXAMPLES = 2400
PRECISION = 0.97
SPAN = "struct<start: int, end: int, match: string, before: string, after: string>"


def running(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """Of an array of whole numbers from 0 on, all sums (or maxima) up to each place.

    Of more than ``CHUNK`` numbers in chunks, each from the total of those before, as
    an array that grows by one number at a time is copied each time.
    """

    def folded(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(acc: Column, v: Column) -> Column:
            now = together(acc["at"], v)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(part, start, step, lambda acc: acc["out"])

    zero = F.lit(0)

    def chunked(v: Column) -> Column:
        chunks = F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK))
        totals = F.transform(chunks, lambda c: F.aggregate(part(c), zero, together))
        before = F.concat(F.array(zero), folded(totals, zero))
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda c: folded(part(c), F.element_at(b, c + 1)))))

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, folded(v, zero)).otherwise(chunked(v)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression that a lambda names is computed again each time."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(found: Column, pieces: Column) -> Column:
    """Matches with places: ``found`` are a pattern's matches, ``pieces`` what is between them."""
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    n = F.size(found)
    before, after = F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n)
    ends = running(F.zip_with(found, before, lambda m, p: F.length(m) + F.length(p)), lambda a, b: a + b)
    around = F.zip_with(before, after, lambda b, a: F.struct(F.right(b, F.lit(AROUND)).alias("before"), F.left(a, F.lit(AROUND)).alias("after")))
    placed = F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))
    spans = F.zip_with(placed, around, lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), y["before"].alias("before"), y["after"].alias("after")))
    return F.when(n > 0, spans).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["match"])


def proposals(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with ``_text`` and an array of located spans ``_<kind>`` for each kind."""
    text, none = F.col("_text"), F.array().cast("array<string>")
    digit = text.rlike("[0-9]")
    patterns = {**BASE, **{kind: pattern for kind, (pattern, _) in GENERATORS.items()}}
    # Most texts have no digit, "@" or "=" and end here.
    guards = {kind: F.contains(text, F.lit("@")) if kind == "email" else F.col("_digit") for kind in BASE}
    guards |= {kind: F.col("_digit") if needs == "[0-9]" else text.rlike(needs) for kind, (_, needs) in GENERATORS.items()}
    out = texts.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_digit", digit)
    out = out.withColumns({f"_found_{k}": F.when(guards[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    out = out.withColumns({f"_pieces_{k}": F.when(F.size(f"_found_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, p in patterns.items()})
    out = out.withColumns({f"_{k}": located(F.col(f"_found_{k}"), F.col(f"_pieces_{k}")) for k in patterns})
    out = out.withColumns({f"_{kind}": F.filter(f"_{kind}", _checked(kind)) for kind in BASE})
    return out.drop("_digit", *[f"_found_{k}" for k in patterns], *[f"_pieces_{k}" for k in patterns])


def _count(match: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(match, pattern, "")).cast("double")


FEATURES = ("length", "digits", "capitals", "small", "marks", "distinct", "changes", "cue_secret", "cue_person", "quoted", "joined", "generator", "plain_number", "year")


def features(kind: str, s: Column) -> list[Column]:
    """Form of a span's head and context, in order of FEATURES."""
    m, yes = F.left(s["match"], F.lit(HEADS[kind])), lambda c: c.cast("double")
    return [
        F.length(m).cast("double"),
        _count(m, "[^0-9]"),
        _count(m, "[^A-Z]"),
        _count(m, "[^a-z]"),
        _count(m, "[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), ""))).cast("double"),
        F.size(F.regexp_extract_all(m, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))).cast("double"),
        yes(F.concat(s["before"], F.left(m, F.lit(16))).rlike(r"(?i)(password|passwd|pwd|secret|token|key|auth|bearer|credential)[^a-z]{0,4}")),
        yes(s["before"].rlike(r"(?i)(phone|tel|call|mobile|fax|ssn|social|passport|iban|account|card|contact|mail|reach)[^0-9]{0,12}$")),
        yes(s["before"].rlike("[\"'=:]\\x20?$")),
        yes(s["before"].rlike(r"[A-Za-z0-9.,$€-]$") | s["after"].rlike(r"^[A-Za-z0-9%€-]|^[.,][0-9]")),
        F.lit(float(list(GENERATORS).index(kind))),
        yes(m.rlike(r"^[0-9]+$")),
        yes(m.rlike(r"(^|[^0-9])(1[5-9]|20)[0-9]{2}([^0-9]|$)")),
    ]


@dataclass(frozen=True)
class Chooser:
    model: Boosted
    thresholds: dict[str, float]


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, personal) made up from a fixed seed; the span is the payload."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hexes, mixed = "0123456789abcdef", upper + lower + digits
    word = lambda: "".join(r.choice(("an", "er", "ti", "on", "the", "ou", "en", "sch", "re", "lo", "ca", "mi", "ed")) for _ in range(r.randint(1, 5)))
    personal = [
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: pick(hexes, r.choice((20, 24, 32, 40, 64))),
        lambda: r.choice(("sk-", "ghp_", "xoxb-", "")) + pick(mixed, r.randint(24, 48)),
        lambda: r.choice(("password", "token", "api_key", "secret", "auth")) + r.choice(("=", ": ", " = ")) + r.choice(("", '"')) + pick(mixed + "!#$%", r.randint(8, 40)),
        lambda: r.choice(("DE", "FR", "ES", "GB")) + pick(digits, 2) + " " + " ".join(pick(digits, 4) for _ in range(r.randint(3, 5))),
        lambda: f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"{pick('123456789', 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        lambda: f"{pick('23456789', 3)}-{pick(digits, 3)}-{pick(digits, 4)}",
        lambda: f"{word()}.{word()} {r.choice(('at', '[at]', '(at)'))} {word()} {r.choice(('dot', '[dot]', '(dot)'))} {r.choice(('com', 'org', 'net'))}",
    ]
    harmless = [
        lambda: "".join(word() for _ in range(6)),
        lambda: "".join(word() for _ in range(6)).upper(),
        lambda: f"{r.randint(1500, 2030)}-{r.randint(1500, 2030)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1990, 2030)}",
        lambda: " ".join(f"{r.randint(0, 999):03d}" for _ in range(r.randint(3, 6))),
        lambda: f"{r.randint(0, 9)}.{pick(digits, r.randint(7, 12))}",
        lambda: pick(digits, r.randint(7, 24)),
        lambda: "-".join(word() for _ in range(r.randint(5, 9))) + f"-{r.randint(1, 99)}",
        lambda: "/".join(word() for _ in range(r.randint(4, 8))) + f"/{r.randint(1, 2030)}",
        lambda: " ".join(f"{r.randint(1, 60)}" for _ in range(r.randint(6, 12))),
        lambda: r.choice(("token", "secret", "key")) + ": " + word() + word() + word(),
        lambda: f"{word()} at {word()} dot {word()}",
        lambda: "".join(word() for _ in range(5)) + str(r.randint(1, 99)),
    ]
    rows = []
    for i in range(n):
        good = i % 2
        payload = r.choice(personal if good else harmless)()
        cue = r.choice(("", "", "", " call", " phone:", " key:", " token =", " account", " ssn", " no.")) if good else r.choice(("", "", "", "", " page", " from", " in", " version", " total"))
        before = " ".join(word() for _ in range(r.randint(1, 6))) + cue + " "
        rows.append((before + payload + " " + " ".join(word() for _ in range(r.randint(1, 4))), len(before), len(before) + len(payload), good))
    return rows


def train(spark: SparkSession, n: int = EXAMPLES) -> Chooser:
    """Trees and thresholds from ``n`` generated examples, read by the expressions used on the corpus."""
    made = spark.createDataFrame(examples(n), "text string, a int, b int, personal int")
    wide = proposals(made)

    def measured(kind: str) -> Column:
        form = lambda s: F.array(*features(kind, s)).alias("f")
        return F.transform(f"_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), form(s)))

    every = wide.select("personal", "a", "b", F.explode(F.concat(*[measured(k) for k in GENERATORS])).alias("s"))
    rows = [(r.s.kind, r.personal, r.a, r.b, r.s.start, r.s.end, *r.s.f) for r in every.collect()]  # a few for each example
    rows.sort(key=lambda x: tuple(map(str, x)))
    x = np.array([r[6:] for r in rows], float)
    y = np.array([r[1] == 1 and r[4] >= r[2] - 1 and r[5] <= r[3] + 1 and (r[5] - r[4]) * 2 >= r[3] - r[2] for r in rows])
    model = fit(x, y)
    p, unseen = model.probability(x), np.arange(len(y)) % 2 == 1
    thresholds = {}
    for kind in GENERATORS:
        mine = unseen & np.array([r[0] == kind for r in rows])
        order = np.argsort(-p[mine], kind="stable")
        precise = np.cumsum(y[mine][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precise >= PRECISION)
        thresholds[kind] = max(0.5, float(p[mine][order][good[-1]])) if len(good) else 2.0
    return Chooser(model, thresholds)


def find(docs: DataFrame, chooser: Chooser, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_<kind>`` for the base kinds, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (kind, start, end, score) in order of kind
    and start; places are code points, ends exclusive; base spans have score 1 and
    all are in ``spans``. Of chosen ones the best comes first (then the first, then the
    first kind); one whose head overlaps a base span, or the head of a span that has
    been taken, is left out. What is taken goes to the end of its value, over base
    spans that stand in the rest; one that lies within another taken before it is
    left out, and one that runs into the next ends there. Null and empty texts have none.
    Columns of these names in ``docs`` are replaced, others stay whatever their names;
    rows are independent of each other.
    """
    names = ["base", "spans", *[f"n_{k}" for k in BASE]]
    kept_names = [c for c in docs.columns if c not in names]
    docs = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept_names]).alias("_row"), F.col(f"`{text_col}`").alias("_t"))
    text_col = "_t"
    wide = proposals(docs, text_col)

    def plain(kind: str, s: Column, score: Column) -> Column:
        head = F.least(s["end"], s["start"] + HEADS[kind]) if kind in HEADS else s["end"]
        order = F.lit(KINDS.index(kind)).alias("o")
        return F.struct(s["start"].alias("start"), order, s["end"].alias("end"), head.alias("head"), F.lit(kind).alias("kind"), score.alias("score"))

    def sure(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: plain(kind, s, F.lit(1.0)))

    def chosen(kind: str) -> Column:
        # Form first, then the trees: each feature is computed once.
        form = lambda s: F.struct(*[c.alias(f"f{i}") for i, c in enumerate(features(kind, s))]).alias("f")
        measured = F.transform(f"_{kind}", lambda s: F.struct(s.alias("s"), form(s)))
        score = lambda c: chooser.model.column([c["f"][f"f{i}"] for i in range(len(FEATURES))])
        return F.filter(F.transform(measured, lambda c: plain(kind, c["s"], score(c))), lambda c: c["score"] >= chooser.thresholds[kind])

    wide = wide.withColumns({"_base": F.concat(*[sure(k) for k in BASE]), "_chosen": F.concat(*[chosen(k) for k in GENERATORS])})
    wide = wide.withColumn("_all", F.array_sort(F.concat("_base", "_chosen")))  # by start
    some = F.size("_chosen") > 0
    none = F.expr("cast(array() as array<struct<start: int, o: int, end: int, head: int, kind: string, score: double>>)")
    taken = F.when(some, F.flatten(F.transform(clusters(F.col("_all")), greedy))).otherwise(none)
    wide = wide.withColumn("_taken", F.array_sort(F.filter(taken, lambda c: c["o"] >= len(BASE))))
    # Values go to their ends: what lies within one that started before goes, what runs into the next is cut.
    open_ = lambda t: let(
        running(F.transform(t, lambda c: c["end"]), larger), lambda reach: F.filter(t, lambda c, i: (i == 0) | (c["end"] > F.get(reach, i - 1)))
    )
    ended = lambda o: F.transform(o, lambda c, i: c.withField("end", F.least(c["end"], F.get(o, i + 1)["start"])))
    whole = F.when(F.size("_taken") > 0, let(F.col("_taken"), lambda t: let(open_(t), ended))).otherwise(none)
    in_order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["o"], s["start"], s["end"], s["kind"].alias("kind"), s["score"].alias("score"))))
    shape = lambda a: F.transform(in_order(a), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    found = {"base": shape(F.col("_base")), "spans": shape(F.concat("_base", whole))}
    out = wide.withColumns(found | {f"n_{kind}": F.size(f"_{kind}").cast("bigint") for kind in BASE})
    return out.select(*[F.col(f"_row.`{c}`") for c in kept_names], *[F.col(c) for c in names])


def clusters(spans: Column) -> Column:
    """Spans in order of start, in arrays of those that overlap directly or through others, by their heads."""

    def parted(s: Column, reach: Column) -> Column:
        firsts = F.filter(F.transform(s, lambda c, i: F.when((i == 0) | (c["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        cut = lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(s))), lambda a, b: F.slice(s, a + 1, b - a))
        return let(firsts, cut)

    return let(spans, lambda s: let(running(F.transform(s, lambda c: c["head"]), larger), lambda reach: parted(s, reach)))


def greedy(spans: Column) -> Column:
    """Base spans, and of the others, best first, each whose head is free."""
    base = len(BASE)
    rank = lambda c: F.struct((c["o"] >= base).alias("added"), (-c["score"]).alias("score"), c["start"].alias("at"), c["o"].alias("o"), c.alias("c"))
    none = F.expr("cast(array() as array<struct<start: int, o: int, end: int, head: int, kind: string, score: double>>)")

    def step(acc: Column, r: Column) -> Column:
        c = r["c"]
        met = F.exists(acc, lambda k: (k["start"] < c["head"]) & (c["start"] < k["head"]))
        return F.when(r["added"] & met, acc).otherwise(F.concat(acc, F.array(c)))

    return F.when(F.size(spans) == 1, spans).otherwise(F.aggregate(F.array_sort(F.transform(spans, rank)), none, step))


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, chooser: Chooser, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets.

    Where spans overlap each other, the text from the first start to the last
    end goes under the kind that starts first. Texts without spans stay as they
    are, null ones too; so do other columns, whatever their names.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find(held, chooser, "text")
    text = F.col("text")
    placed = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        added = F.concat(acc["out"], F.array(F.concat(between, F.lit("<"), s["kind"], F.lit(">"))))
        end = F.greatest(acc["at"], s["end"])
        out = F.when(s["start"] >= acc["at"], added).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    cleaned = F.when(F.size("spans") > 0, F.aggregate("_placed", start, step, finish)).otherwise(text)
    made = found.withColumn("_placed", placed).withColumn("_cleaned", cleaned)
    return made.select(*[F.col("_cleaned").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
