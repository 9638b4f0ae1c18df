"""The training-data operators against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import boosting, common, components, kdtree, licenses, media, packing, pieces, pii, quality, sharding, simhash, suffix_dedup
from tidemark.llm.queries import oracle_sql, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and licence river stone quiet lamp window paper garden seven light under over green table road winter apple".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 999)) * (r.random() < 0.2) for _ in range(n))


def odd_rows():
    passage = prose(99, 120)
    texts = [
        None, "", " ", "a", "x" * 5000, prose(1, 40), prose(1, 40), prose(2, 300), passage, prose(3, 30) + " " + passage + " " + prose(4, 30),
        prose(5, 10) + "\n" + passage, "é ñ 日本語 🎉 \x00 ▁ x", "ab" * 900, "line of text\n" * 200, "Released under the MIT License.", "9" * 3000,
        "mail a.b@c.de or +1 (555) 010-9999, host 10.0.0.255, card 4111 1111 1111 1111", "@" * 50 + "1.2.3.4.5", prose(7, 6000),
    ]
    rows = [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[7], (None, texts[5], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id(rows):
    return {r[0]: r[1] or "" for r in rows}


# 1 -------------------------------------------------------------------------------


def brute_removed(texts, length):
    seen = collections.Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "depths"), [(400, (128, 336)), (60, (20, 50)), (40, (10,))])
def test_repeats_against_brute_force(spark, length, depths):
    r = random.Random(length)
    shared = [prose(50 + k, 60) for k in range(4)]
    rows = odd_rows() + [(100 + k, prose(k, r.randint(1, 90)) + r.choice(shared)[: r.randint(10, 500)] + prose(k + 500, 20), None, None, None) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r)[:5] for r in suffix_dedup.repeat_digests(docs, length=length, depths=depths).collect()]
    raw = [(row[1] or "").encode() for row in rows]
    want = []
    for row, b, gone in zip(rows, raw, brute_removed(raw, length)):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((row[0], len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert collections.Counter(got) == collections.Counter(want)


def test_equal_windows_have_equal_anchors_in_texts_of_any_size():
    window = np.frombuffer(prose(1, 200).encode()[:400], np.uint8)
    found = set()
    for before in (0, 1, 77, 5000):
        data = np.concatenate([np.frombuffer(prose(before, 4000).encode()[:before], np.uint8), window, np.frombuffer(b" tail" * 30, np.uint8)])
        _, gram, _, lo, hi = suffix_dedup.anchors(data, np.array([0, len(data)]), 400, (128,))
        found.add(int(gram[(lo <= before) & (before <= hi)][0]))
    assert len(found) == 1


def brute_passages(rows, n):
    """Words of each text that some n words cover which another row (of other id or text) has too."""
    owners = collections.defaultdict(set)
    for row in rows:
        w = (row[1] or "").encode().split()
        for s in range(len(w) - n + 1):
            owners[tuple(w[s : s + n])].add((row[0], row[1]))
    out = []
    for row in rows:
        w = (row[1] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - n + 1):
            gone[s : s + n] |= len(owners[tuple(w[s : s + n])]) > 1
        out.append(gone)
    return out


def passage_rows():
    r = random.Random(3)
    shared = [prose(700 + k, 53).split() for k in range(5)]
    rows = odd_rows()
    for k in range(80):
        part = r.choice(shared)
        part = part[r.randint(0, 4) : len(part) - r.randint(0, 4)]
        rows.append((100 + k, prose(k, r.randint(0, 60)) + r.choice((" ", "\n", " \t")) + r.choice((" ", "\n ")).join(part) + " " + prose(k + 500, 20), None, None, None))
    said = prose(800, 55)  # twice in one text, so no repeat, but parts of it stand elsewhere
    rows += [(200, f"{said} and {said}", None, None, None), (201, "so " + " ".join(said.split()[2:54]), None, None, None)]
    return rows + [(300, prose(900, 60) + " x " + prose(900, 60), None, None, None), rows[-1]]


@pytest.mark.parametrize("n", [50, 51, 60])
def test_passages_of_words_against_brute_force(spark, n):
    rows = passage_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kind = suffix_dedup.Repeats(n, (16, 42), words=True, across=True)
    want, texts = [], []
    for row, gone in zip(rows, brute_passages(rows, n)):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want.append((row[0], int((edges == 1).sum()), int(gone.sum())))
        texts.append((row[0], tuple(w for w, g in zip((row[1] or "").encode().split(), gone) if not g)))
    got = suffix_dedup.repeat_digests(docs, passages=kind).select("doc_id", "n_passages", "n_passage_words").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert sum(w[2] for w in want) > 300
    cut = suffix_dedup.remove_repeats(docs, repeats=kind).collect()
    assert collections.Counter((r.doc_id, tuple((r.text or "").encode().split())) for r in cut) == collections.Counter(texts)


def test_long_texts_are_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PORTION", 2000)
    values = np.random.default_rng(1).integers(0, 4, 30_000).astype(np.uint8)
    offsets = np.array([0, 12_000, 12_000, 12_500, 30_000])
    got = suffix_dedup.anchors(values, offsets, 400, (128,))
    covered = collections.Counter((o, p) for o, lo, hi in zip(got[0].tolist(), got[3].tolist(), got[4].tolist()) for p in range(lo, hi + 1))
    assert covered == collections.Counter((o, p) for o, n in enumerate(np.diff(offsets).tolist()) for p in range(n - 399))
    assert (suffix_dedup.word_values(values, np.array([0, 5000]), np.array([4000, 5003]))[1:] == suffix_dedup.word_values(values[5000:], np.array([0]), np.array([3]))).all()


def test_identifiers_of_deeper_buckets_tell_strings_apart():
    data = np.frombuffer(("abcab" * 40 + prose(1, 40)).encode(), np.uint8)
    for depths in ((8, 20), (8, 16, 40), (5, 7, 7)):
        ids, q = suffix_dedup.identifiers(data, depths), depths[-1]
        strings = [data[i : i + q].tobytes() for i in range(len(data) - q + 1)]
        assert len(ids) == len(strings) and len(set(zip(ids.tolist(), strings))) == len(set(strings)) == len(set(ids.tolist()))


def test_repeats_keep_columns_and_valid_text(spark, odd, none):
    clash = odd.withColumn("windows", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("print", F.lit(2))
    got = suffix_dedup.remove_repeats(clash)
    assert got.columns == clash.columns and got.count() == clash.count()
    assert got.where("text is null").count() == odd.where("text is null").count()
    assert suffix_dedup.remove_repeats(none).count() == 0
    # Characters that a cut of bytes would part stay.
    assert suffix_dedup.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]
    assert suffix_dedup.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters("日本".encode(), [(1, 2)]) == []
    wide = "é" * 300
    rows = [(1, "a" + wide, None, None, None), (2, wide, None, None, None)]
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text in ("a", "")


# 2 -------------------------------------------------------------------------------


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, extra = 0.0, set()
    for s in range(0, max(len(words) - 33, 0) + 1, 32):
        block, shares = set(words[s : s + 64]), {}
        for label, t in licenses.TEMPLATES.items():
            t = set(licenses.template_words(t))
            if len(t & block) >= math.ceil(0.8 * len(t) - 1e-9) and set(licenses.MUST.get(label, "").split()) <= block:
                shares[label] = len(t & block) / len(t)
        for label, share in shares.items():
            if not set(licenses.NARROWER.get(label, "").split()) & set(shares):
                extra.add(label)
                best = max(best, share)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | extra)), 1.0 if labels else best


def test_licences_that_differ_by_a_word_get_their_own_labels(spark):
    said = {
        "This work is licensed under the GNU General Public License version 3": {"gpl", "gpl-3.0"},
        "licensed under the GNU General Public License version 3": {"gpl"},
        "Licensed under the GNU Affero General Public License version 3": {"agpl-3.0"},
        "licensed under the GNU Lesser General Public License": {"lgpl"},
        "licensed under CC BY 4.0 Creative Commons Attribution": {"cc-by", "cc-by-4.0"},
        "licensed under CC BY SA 4.0": {"cc-by", "cc-by-sa-4.0"},
        "Licensed under CC BY NC 4.0 Creative Commons Attribution": {"cc-by", "cc-by-nc-4.0"},
        "the film was released under the new license": set(),
        "released under the MIT License": {"mit", "mit-notice"},
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files": {"mit-text"},
    }
    found = {r.text: r.labels for r in licenses.scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()}
    assert found == {t: ",".join(sorted(x)) for t, x in said.items()}


def test_licenses_against_brute_force(spark, none):
    texts = [r[1] for r in odd_rows()] + [
        "MIT License MIT license; the GNU General   Public-License. CC BY-NC 4.0", "licensed under the Apache license, version 2.0 " * 3,
        "x " * 70 + "this program is free software you can redistribute it and or modify it under the terms of the gnu license " + "y " * 70,
        " ".join(f"w{i}" for i in range(500)) + " permission is hereby granted free of charge to any person obtaining a copy",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("labels", F.lit("old"))
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_license(t), t
    assert licenses.scan(none).count() == 0


def test_wrapped_notices_are_found(spark):
    rows = []
    for label, t in licenses.TEMPLATES.items():
        words = t.split()
        for k, step in enumerate((3, 9, 99)):
            notice = "\n".join(" ".join(words[i : i + step]) for i in range(0, len(words), step))
            rows += [(f"{label} {k} {n}", label, f"{prose(n, n)}\n{notice}\n{prose(n + 1, 70)}") for n in (0, 29, 61)]
    docs = spark.createDataFrame(rows, "name string, label string, text string")
    for r in licenses.scan(docs).collect():
        assert r.label in [b.label for b in r.blocks] and r.label in r.labels.split(",") and r.score == 1.0, r.name


def test_own_templates_thresholds_and_columns(spark, none):
    long = prose(31, 60) + " " + prose(32, 60)
    docs = spark.createDataFrame([(1, prose(5, 50) + " " + long + " " + prose(6, 50)), (2, "Keep this Notice, please!"), (3, None), (4, "keep nothing")], "_words int, text string")
    table = spark.createDataFrame([("long", long), ("keep", "keep this NOTICE please"), (None, "x"), ("none", "..")], "label string, text string")
    for threshold, keep in ((0.8, 0), (0.5, 0), (0.25, 1)):
        got = {r._words: r for r in licenses.scan(docs, threshold=threshold, templates=table).collect()}
        assert "long" in [b.label for b in got[1].blocks] and got[2].labels == "keep" and got[2].score == 1.0
        assert got[3].labels == "" and got[3].score == 0.0 and len(got[4].blocks) == keep
    assert licenses.scan(docs, templates={}).where("score > 0").count() == 0 and licenses.scan(none, templates=table).count() == 0
    many = spark.range(licenses.MOST_TEMPLATES + 1).selectExpr("string(id) AS label", "'a b' AS text")
    for bad in (lambda: licenses.scan(docs, templates=many), lambda: licenses.scan(docs, threshold=0), lambda: licenses.scan(docs, templates=table.unionByName(table))):
        with pytest.raises(ValueError):
            bad()


# 3 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chooser(spark):
    return pii.train(spark, 800)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_base_kinds_against_plain_patterns(spark, chooser):
    r = random.Random(5)
    texts = [row[1] for row in odd_rows()] + ["".join(r.choice("ab@.1234 +-()_é") for _ in range(r.randint(1, 120))) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "256.1.1.1", "000255.1.1.1", "1.2.3.4.5.6.7.8", "+1" + "(" * 3000, "4" * 16, "1 " * 4000, "x@" * 2000, "a" * 20000 + "@", "🎉 a@b.co"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {x.doc_id: x for x in pii.find(docs, chooser).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if passes(k, m.group())]
        assert [(s.kind, s.start, s.end) for s in got[i].base] == want, t
        spans = [(s.kind, s.start, s.end) for s in got[i].spans]
        assert set(want) <= set(spans)
        extra = sorted(s[1:] for s in spans if s[0] not in PLAIN)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(extra))


def test_secrets_are_found_and_prose_is_left_alone(spark, chooser):
    r = random.Random(8)
    secrets = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(20)]
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    rows = [(i, f"some words {s} and more") for i, s in enumerate(secrets)] + [(100 + i, f'set token = "{s}" here') for i, s in enumerate(hexes)]
    rows += [(200 + i, prose(i, 80)) for i in range(50)]
    got = {x.doc_id: len(x.spans) for x in pii.find(spark.createDataFrame(rows, "doc_id int, text string"), chooser).collect()}
    assert sum(got[i] > 0 for i in got if i < 200) >= 38
    assert sum(got[i] > 0 for i in got if i >= 200) == 0


@pytest.mark.parametrize("length", [600, 5000])
def test_long_secrets_go_to_their_end(spark, chooser, length):
    r = random.Random(length)
    made = lambda alphabet: "".join(r.choice(alphabet) for _ in range(length))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed, card = letters + letters.lower() + "0123456789", "x4111111111111111x"
    long = [made(mixed), made(mixed + "+/"), "sk-" + made(mixed), "token=" + made(mixed), "password=" + made(mixed)]
    long += [s[:560] + card + s[560:] for s in long]
    texts = [f"some words {s} and more" for s in long]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {x.doc_id: [s for s in x.spans if s.kind in pii.GENERATORS] for x in pii.find(docs, chooser).collect()}
    redacted = {x.doc_id: x.text for x in pii.redact(docs, chooser).collect()}
    chosen = [i for i in found if found[i]]
    assert len(chosen) >= 8
    for i in chosen:
        assert max(s.end for s in found[i]) == len(texts[i]) - len(" and more"), texts[i][:80]
        assert all(a.end <= b.start for a, b in itertools.pairwise(sorted(found[i], key=lambda s: s.start)))
        assert re.search(r"<(credential|key|token)> and more$", redacted[i]) and len(redacted[i]) < 120, redacted[i][:200]


def test_chosen_heads_of_keys_and_digit_groups_go_to_their_end(spark):
    every = pii.Chooser(boosting.Boosted(0.0, 1.0, ()), {k: 2.0 if k in ("token", "account", "contact") else 0.0 for k in pii.GENERATORS})
    values = ["555-010-9999 " * 4 + "1", "7" * 90, "AB12" * 60, "7" * 30 + " " + "AB12" * 60, "secret=" + "AB12" * 60, "secret=" + "ab!." * 900]
    docs = spark.createDataFrame([(i, f"call {v} now") for i, v in enumerate(values)], "doc_id int, text string")
    assert {x.doc_id: re.sub("<[a-z]+>", "<>", x.text) for x in pii.redact(docs, every).collect()} == {i: "call <> now" if i != 3 else "call <> <> now" for i in range(6)}


def test_running_sums_and_maxima_in_chunks(spark):
    r = random.Random(2)
    rows = [([r.randint(0, 99) for _ in range(n)],) for n in (1, 2, 127, 128, 129, 256, 257, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", pii.running(F.col("v"), lambda a, b: a + b).alias("sums"), pii.running(F.col("v"), pii.larger).alias("tops")).collect()
    for x in got:
        assert x.sums == list(itertools.accumulate(x.v)) and x.tops == list(itertools.accumulate(x.v, max))


def brute_greedy(spans):
    """(start, head, end, score, kind number) that stay: base ones, and of others the best that are free."""
    taken = [s for s in spans if s[4] < len(pii.BASE)]
    for s in sorted((s for s in spans if s[4] >= len(pii.BASE)), key=lambda s: (-s[3], s[0], s[4])):
        if all(s[0] >= t[1] or t[0] >= s[1] for t in taken):
            taken.append(s)
    return sorted(taken)


def test_overlaps_are_taken_greedily(spark):
    r = random.Random(9)
    chain = [(0, 10, 10, 0.8, 5), (8, 20, 20, 0.9, 6), (18, 30, 30, 0.95, 7)]  # the middle one goes, so the first stays
    rows = [chain] + [
        [(a, a + n, a + n, r.choice((0.5, 0.7, 0.9)), r.randrange(len(pii.KINDS))) for a, n in ((r.randint(0, 400), r.randint(1, 30)) for _ in range(r.choice((1, 5, 40, 300))))]
        for _ in range(40)
    ]
    data = [(i, [(s[0], s[4], s[2], s[1], pii.KINDS[s[4]], s[3]) for s in row]) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, s array<struct<start: int, o: int, end: int, head: int, kind: string, score: double>>")
    got = df.withColumn("s", F.array_sort("s")).select("i", F.flatten(F.transform(pii.clusters(F.col("s")), pii.greedy)).alias("s")).collect()
    for x in got:
        assert sorted((s.start, s.head, s.end, s.score, s.o) for s in x.s) == brute_greedy(rows[x.i]), x.i
    assert len(brute_greedy(chain)) == 2


def test_many_spans_in_one_text_take_little_time(spark, chooser):
    import time

    text = " ".join(f"call +1 555 01{i % 100:02d} {i % 9000 + 1000} or mail a{i}@b.org, key = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"." for i in range(4000))
    began = time.time()
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string"), chooser).collect()
    assert row.n_email == 4000 and row.n_phone == 4000 and len(row.spans) >= 11_000
    assert time.time() - began < 60
    plain = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]
    assert [(s.kind, s.start, s.end) for s in row.base] == plain


def test_redaction(spark, odd, none, chooser):
    docs = spark.createDataFrame([(1, "🎉 to a.b@c.de from 10.0.0.1!", 5), (2, None, 5), (3, "plain", 5)], "doc_id int, text string, spans int")
    assert [tuple(r) for r in pii.redact(docs.withColumn("_text", F.lit("t")), chooser).select("spans", "_text").collect()] == [(5, "t")] * 3
    found = pii.find(docs.withColumnRenamed("doc_id", "_t"), chooser)
    assert found.columns == ["_t", "text", "base", "spans", *[f"n_{k}" for k in pii.BASE]]
    assert [r.text for r in pii.redact(docs, chooser).orderBy("doc_id").collect()] == ["🎉 to <email> from <ip>!", None, "plain"]
    assert pii.redact(docs, chooser).columns == docs.columns
    assert pii.redact(odd, chooser).count() == odd.count() and pii.redact(none, chooser).count() == 0


def test_boosted_trees_learn_and_equal_their_expression(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.5)
    model = boosting.fit(x, y)
    p = model.probability(x)
    assert ((p > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], "a double, b double, c double")
    got = [v[0] for v in df.select(model.column([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(got, p[:50])


# 4 -------------------------------------------------------------------------------


def test_stored_texts_come_back(spark, odd, none):
    got = media.stored_text(odd).collect()
    assert len(got) == odd.count() and media.stored_text(none).count() == 0
    want = texts_by_id(odd_rows())
    for r in got:
        if r.doc_id is None:
            continue
        raw = want[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(media.wrap(payload)).hexdigest()


def test_containers_of_many_chunks_and_broken_ones(spark):
    payload = bytes(range(256)) * 9 * 64
    whole = media.wrap(payload)
    (track,) = media.inspect(whole)
    assert media.read_samples(whole, track) == payload
    assert (track.codec, track.width, track.height, track.timescale, track.duration) == ("raw ", 24, 24, 25, len(payload) // 576)
    keys = track.keyframes()
    assert keys == [(32 + i * 576, 32 + i * 576 + 576) for i in range(0, len(payload) // 576, 25)]
    for cut in (0, 3, 7, 20, len(whole) // 2, len(whole) - 10):
        media.inspect(whole[:cut])
    assert media.inspect(b"not a container at all") == []
    big = whole[:24] + struct.pack(">I4sQ", 1, b"free", 24) + bytes(8) + whole[24:]
    assert media.inspect(big)[0].codec == "raw "
    df = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"zzz")), (3, None)], "id int, media binary").withColumn("codec", F.lit("old"))
    got = {r.id: r for r in media.media_columns(df).collect()}
    assert got[1].codec == "raw " and len(got[1].keyframes) == len(keys) and got[1].duration_seconds == len(payload) / 576 / 25
    assert got[2].codec is None and got[3].keyframes is None
    assert [t.handler for t in got[1].tracks] == ["vide"] and got[1].tracks[0].keyframes == got[1].keyframes and got[3].tracks is None


def test_broken_containers_never_crash_or_swell():
    whole = media.wrap(bytes(range(256)) * 9)
    deep = b""
    for _ in range(5000):
        deep = media.box(b"moov", deep)
    assert media.inspect(deep) == []
    trak = media.box(b"trak", media.box(b"mdia", media.box(b"mdhd")))
    assert media.inspect(media.box(b"moov", trak))[0].timescale == 0  # an empty header
    huge = media.box(b"moov", media.box(b"trak", media.full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF))))
    assert media.inspect(huge)[0].count <= len(huge)
    r = random.Random(5)
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(r.randint(1, 6)):
            data[r.randrange(32 + 2304 if r.random() < 0.9 else 0, len(data))] = r.choice((0, 1, 255, r.randrange(256)))
        for track in media.inspect(bytes(data[: r.randint(1, len(data))])):
            media.describe(track)
            media.read_samples(bytes(data), track)


def test_fragments_and_several_tracks(spark):
    def track(number, kind, codec):
        header = media.full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(72))
        sizes = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(40))))
        return media.box(b"trak", header, media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIII", 0, 0, 10, 0, 0)), media.full(b"hdlr", struct.pack(">I4s12x", 0, kind)), sizes))

    usual = media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 2, 1, 5, 100, 0x10000)))
    head = media.box(b"moov", track(1, b"soun", b"mp4a"), track(2, b"vide", b"avc1"), usual)
    for plain in (True, False):
        # Three samples of 100 bytes and 5 ticks, the first a keyframe; or of sizes, ticks and flags of their own.
        if plain:
            run = media.full(b"trun", struct.pack(">IiI", 3, 0, 0), flags=0x5)
        else:
            run = media.full(b"trun", struct.pack(">Ii9I", 3, 0, 7, 10, 0, 8, 20, 0x10000, 9, 30, 0), flags=0x701)
        size = 8 + len(media.full(b"tfhd", struct.pack(">I", 2), flags=0x20000)) + len(run) + 8
        at = size + 8
        run = run[:16] + struct.pack(">i", at) + run[20:]
        moof = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2), flags=0x20000), run))
        assert len(moof) == size
        data = head + moof + media.box(b"mdat", bytes(300))
        start = len(head) + at
        sound, video = media.inspect(data)
        assert (sound.handler, sound.codec, sound.count) == ("soun", "mp4a", 0)
        want = [(start, 100), (start + 100, 100), (start + 200, 100)] if plain else [(start, 10), (start + 10, 20), (start + 30, 30)]
        assert video.samples() == want and video.seconds == (1.5 if plain else 2.4)
        assert video.keyframes() == ([(start, start + 100)] if plain else [(start, start + 10), (start + 30, start + 60)])
    (row,) = media.media_columns(spark.createDataFrame([(1, bytearray(data))], "tracks int, media binary")).collect()
    assert row.codec == "avc1" and row.samples == 3 and [t.codec for t in row.tracks] == ["mp4a", "avc1"]


# 5 -------------------------------------------------------------------------------


def test_classifier_separates_held_out_rows_and_copes_with_odd_ones(spark, odd, none):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = r.random() < 0.7
        text = prose(i, 60) if good else " ".join(w + r.choice(("!!", "$$$", "***")) for w in prose(i, 60).split())
        rows.append((i, text, None, None, None))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (99999, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, marks, per_class=100)
    held = {x.doc_id: x.score for x in quality.score(docs.where(quality.fold_of() == 0), model).collect()}
    wrong = sum((s >= 0.3) != labels[i][1] for i, s in held.items())
    assert len(held) > 50 and wrong <= 0.03 * len(held)
    scores = [x.score for x in quality.score(odd.withColumn("score", F.lit("old")), model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, model).count() == 0
    for few in (marks.where("false"), marks.where("quality = 1")):
        assert all(0 < x.score < 1 for x in quality.score(odd, quality.train(docs, few)).collect())


def test_features_ignore_nothing_but_order_of_rows():
    assert quality.features(None).tolist() == quality.features("").tolist() == quality.features(" \n").tolist() == [0]
    assert set(quality.features("Ab ab")) != set(quality.features("ab ab"))
    assert quality.features("x" * 10**6).size < 20


# 6 -------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_samples_follow_the_lattice_and_decode_to_the_text():
    coder = pieces.Sampler(PIECES)
    for t in [r[1] or "" for r in odd_rows()] + ["a" + " " * 40 + "b", "\n\n", " lead", "tail ", "▁▁"]:
        (ids,) = coder.encode([t], [1])
        assert coder.vocabulary.decode(ids) == t.encode()
    v, word = coder.vocabulary, "hand"
    full = pieces.SPACE + word
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = {p.id_to_piece(i): i for i in range(p.vocab_size()) if not p.is_byte(i)}
    ways = {}

    def walk(at, path, weight):
        if at == len(full):
            ways[tuple(path)] = weight
        for end in range(at + 1, len(full) + 1):
            i = known.get(full[at:end])
            if i is not None:
                walk(end, [*path, i], weight * math.exp(pieces.THETA * max(p.get_score(i), -float(v.size))))

    walk(0, [], 1.0)
    n, total = 40_000, sum(ways.values())
    got = collections.Counter(tuple(x.tolist()) for x in coder.encode([word] * n, list(range(n))))
    assert set(got) <= set(ways)
    for path, weight in ways.items():
        share = weight / total
        assert abs(got[path] / n - share) <= 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_long_stretches_are_one_lattice():
    v = pieces.Sampler(PIECES).vocabulary
    r = random.Random(4)
    seeds = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    # Up to the range of doubles the lattice of short stretches holds long ones too: same seeds, same pieces.
    for stretch in ("a" * 150, "".join(r.choice("internationalization") for _ in range(200)), "".join(r.choice("日本語の文字列") for _ in range(100)), pieces.SPACE * 90 + "x"):
        whole = pieces.Lattices(v, [stretch])
        ids, counts = whole.draw(np.zeros(len(seeds), np.int64), seeds)
        want = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        for chunk in (7, 64, 1000):
            assert [x.tolist() for x in pieces.LongLattice(v, stretch, chunk).draw(seeds)] == want
    # And a stretch of 10,000 characters in chunks is the one that is a single chunk.
    stretch = "".join(r.choice(("station", "er", "日", "文", "x", "q", "🎉", "0")) for _ in range(6000))[:10_000].replace("0", "o")
    assert len(stretch) == 10_000
    parts, whole = pieces.LongLattice(v, stretch, 512).draw(seeds[:6]), pieces.LongLattice(v, stretch, 1 << 20).draw(seeds[:6])
    assert [x.tolist() for x in parts] == [x.tolist() for x in whole] and len({tuple(x.tolist()) for x in parts}) == 6
    coder = pieces.Sampler(PIECES)
    texts = [stretch, "short " + stretch[:500] + " " * 300 + stretch[:500] + "\n" + stretch[:64] + "!" * 65, stretch]
    encoded = coder.encode(texts, [1, 2, 1])
    assert [coder.vocabulary.decode(x).decode() for x in encoded] == texts and encoded[0].tolist() == encoded[2].tolist()
    # No piece is barred from a place: pieces lie over every multiple of 64.
    ends = np.cumsum([len(coder.vocabulary.written[i]) for i in coder.encode(["a" * 6400], [3])[0].tolist()]) - 1
    assert not set(range(64, 6400, 64)) <= set(ends.tolist())


def test_samples_depend_on_key_and_seed_only(spark, odd, none):
    docs = odd.where("doc_id is not null").withColumn("ids", F.lit(0))
    a = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs, PIECES).collect()}
    b = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs.repartition(7), PIECES).collect()}
    c = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs, PIECES, seed=1).collect()}
    assert a == b and a != c
    back = pieces.decode(pieces.encode(docs, PIECES).select("doc_id", "ids"), PIECES)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r[0], r[1] or "") for r in odd_rows() if r[0] is not None}
    assert all(r.lossless for r in pieces.digests(odd, PIECES).collect()) and pieces.digests(none, PIECES).count() == 0


# 7 -------------------------------------------------------------------------------


def brute_simhash(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_against_brute_force():
    for row in odd_rows():
        assert simhash.simhash64(row[1]) == brute_simhash(row[1])


def test_near_duplicates_against_brute_force(spark, odd, none):
    texts = texts_by_id(r for r in odd_rows() if r[0] is not None)
    for k in range(60):
        words = prose(k % 6 + 300, 250).split()
        for _ in range(k % 4):
            words[random.Random(k).randrange(250)] = f"other{k}"
        texts[1000 + k] = " ".join(words)
    prints = {i: brute_simhash(t) for i, t in texts.items()}
    want = brute_components(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    least = {}
    for i, c in want.items():
        least[c] = min(i, least.get(c, i))
    assert got == {i: least[c] for i, c in want.items()}
    again = simhash.near_duplicates(odd).collect()
    assert len(again) == odd.count()
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    assert kept.where("doc_id is null").count() == 2


def test_similar_texts_are_dropped_and_others_kept(spark, none):
    r = random.Random(12)
    rows, copies = [], set()
    for k in range(30):
        base = prose(700 + k, 300).split()
        rows.append((k * 100, " ".join(base)))
        for c in range(1, r.choice((1, 2, 12))):
            words = list(base)
            for at in r.sample(range(300), 5):
                words[at] = f"w{k}x{c}x{at}"
            rows.append((k * 100 + c, " ".join(words)))
            copies.add(k * 100 + c)
    rows += [(9000 + k, "Released under the MIT License, as all of these are. " + prose(k, 200)) for k in range(40)] + [(9500, None), (9501, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("fp", F.lit("x"))
    kept = simhash.keep_one(docs, similarity=0.8)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - copies - {9501}
    assert simhash.keep_one(none, similarity=0.8).count() == 0
    sets = [set(simhash.shingle_set(t).tolist()) for t in ("a b c d e f", "A b  c d e\nf", "a b", "")]
    assert len(sets[0]) == 2 and sets[0] == sets[1] and len(sets[2]) == 1 and not sets[3]


def edited(words, n, tag, seed):
    """``words`` with ``n`` of them replaced by words of its own."""
    out = list(words)
    for at in random.Random(seed).sample(range(len(out)), n):
        out[at] = f"{tag}x{at}"
    return out


def test_all_similar_texts_are_linked_as_by_brute_force(spark):
    rows, families = [], 12
    for k in range(families):
        # Copies of a text that is gone, edited on their own: some pairs overlap by 0.8, others do not.
        base = prose(4000 + k, 250).split()
        rows += [(k * 1000 + c, " ".join(edited(base, random.Random(k * 99 + c).randint(3, 8), f"k{k}c{c}", k * 99 + c))) for c in range(14)]
        # A chain that drifts, and a heavy text that shares a part with all of its links.
        chain = [prose(5000 + k, 220).split()]
        for c in range(8):
            chain.append(edited(chain[-1], 4, f"k{k}d{c}", c))
        rows += [(k * 1000 + 100 + c, " ".join(w)) for c, w in enumerate(chain)]
        rows += [(k * 1000 + 200 + c, " ".join(chain[c][:165] + prose(6000 + k, 60).split())) for c in range(8)]
    rows.append((99_000, "a b"))
    r = random.Random(1)
    r.shuffle(rows)
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    prints = {i: brute_simhash(t) for i, t in rows}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) or (prints[a] ^ prints[b]).bit_count() <= 2

    want = brute_components(sorted(sets), linked)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id for x in simhash.keep_one(docs, similarity=0.8).collect()} == set(want.values())
    assert families < len(set(want.values())) < len(rows)


def test_common_shingles_go_last_and_prefixes_still_meet():
    r = np.random.default_rng(8)
    pool = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    for share in (0, 50, 300):
        keys = np.sort(r.choice(pool, share, replace=False))
        common = keys, r.integers(4, 90, share)
        sets = [np.sort(r.choice(pool[:130], int(n), replace=False)) for n in r.integers(100, 130, 60)]
        firsts = [simhash.prefix(s, common, 0.8) for s in sets]
        size, root = np.array([len(x) for x in sets]), np.arange(60) // 3
        lists = [np.unique(f.view(np.int64) >> 32) for f in firsts]
        alike = {(a, b) for a, b in itertools.combinations(range(60), 2) if 1.8 * len(np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]))}
        for tile, long in ((512, 0), (7, 0), (16, 9)):
            simhash.TILE, before = tile, simhash.TILE
            shared, named = collections.Counter(), collections.Counter()
            for key in np.unique(np.concatenate(lists)).tolist():
                mine = np.array([i for i in range(60) if key in lists[i]])
                own = [None if i < long else lists[i] for i in mine]
                for found in simhash.crossing_pairs(key, mine, root[mine], size[mine], own, 0.8):
                    for a, b, n, need in found.tolist():
                        shared[a, b, need] += n
                        named[a, b] += 1
            simhash.TILE = before
            got = {(a, b) for a, b, need in shared if shared[a, b, need] >= need}
            assert {p for p in alike if p[0] // 3 != p[1] // 3} <= got and all(a // 3 != b // 3 for a, b in got)
            assert all(n == 1 for (a, b), n in named.items() if min(a, b) >= long)


def test_links_in_small_and_large_sets_are_the_same():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base[r.integers(0, 40, 900)] ^ (np.uint64(1) << r.integers(0, 64, 900, dtype=np.uint64)) for _ in range(2)]))
    assert len(prints) > 512
    want = brute_components(range(len(prints)), lambda a, b: int(prints[a] ^ prints[b]).bit_count() <= 2)

    def groups(edges):
        root = brute_components(range(len(prints)), lambda a, b: False)
        for a, b in edges:
            x, y = root[a], root[b]
            root = {n: (x if c == y else c) for n, c in root.items()}
        return {frozenset(n for n in root if root[n] == c) for c in root.values()}

    assert groups(simhash.local_links(prints)) == {frozenset(n for n in want if want[n] == c) for c in want.values()}


def test_popcounts_bound_the_distance_and_links_meet_at_a_point():
    r = np.random.default_rng(5)
    for _ in range(300):
        a = int(r.integers(0, 1 << 63))
        b = a
        for bit in r.integers(0, 64, r.integers(0, 3)):
            b ^= 1 << int(bit)
        u, v = simhash.segment_counts(np.array([a, b], np.uint64))
        assert np.abs(u - v).sum() <= (a ^ b).bit_count()
        around = lambda c: {tuple(c)} | {tuple(c + s * e) for e in np.eye(16, dtype=int) for s in (-1, 1) if ((c + s * e) >= 0).all() and ((c + s * e) <= 4).all()}
        assert around(u) & around(v)


def test_crowded_points_give_the_same_groups(spark):
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints) * 3:
        for _ in range(r.randint(1, 4)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "fp bigint, rep bigint")
    got = []
    for crowd in (0, 3, 4096):
        roots = components.connected_components(simhash.near_links(df, crowd))
        got.append({x.node: x.root for x in roots.collect()})
    want = brute_components([i for _, i in rows], lambda a, b: ((rows[a][0] ^ rows[b][0]) & (1 << 64) - 1).bit_count() <= 2)
    assert got[0] == got[1] == got[2] == {n: root for n, root in want.items() if n != root}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.connected_components(edges.where("false")).count() == 0


# 8 -------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = r.integers(-3, 4, (700, 6))
    vectors[200:320] = vectors[0]  # one very common vector: ties
    rows = [(i, [float(x) / 2 for x in v]) for i, v in enumerate(vectors)]
    rows += [(9000, None), (9001, [1.0, None]), (9002, [float("nan")] * 6), (9003, [float("inf")] * 6), (None, [1.0] * 6), (9005, [])]
    df = kdtree.scaled(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for x in kdtree.top_k(df, df.where("id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    for q in [i for i in ints if i % 20 == 0]:
        scored = [(sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q]
        assert got[q] == [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:20]]
    assert kdtree.top_k(df.where("false"), df.where("false")).count() == 0
    assert kdtree.top_k(df.where("id < 5"), df.where("id = 0")).count() == 4


def test_trees_prune_and_agree_with_a_scan():
    r = np.random.default_rng(6)
    points = r.integers(-64, 65, (3000, 4))
    tree = kdtree.build_tree(np.arange(3000), points, leaf=16)
    for q in points[:20]:
        want = sorted(((-int(s), i) for i, s in enumerate(points @ q)))[:5]
        assert kdtree.search_tree(tree, q, own=-1, k=5) == [(-s, i) for s, i in want]
        assert kdtree.search_tree(tree, q, own=-1, k=5, kth=-want[0][0] + 1) == []


# 9 -------------------------------------------------------------------------------


def test_shards_are_even_and_mixed(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 7}") for i in range(5000)] + [(None, None), (1, "big"), (1, "big")]
    docs = spark.createDataFrame(rows, "id bigint, source string")
    got = sharding.interleave(docs, 24).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    per = collections.Counter((r.source, r.shard) for r in got)
    for source, n in collections.Counter(r.source for r in got).items():
        counts = [per[source, s] for s in range(24)]
        assert max(counts) - min(counts) <= 4, source
    again = sharding.interleave(docs.repartition(5), 24).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    few = sharding.interleave(docs.limit(5), 24).collect()
    assert len({r.shard for r in few}) == 5 and all(r.slot == 0 for r in few)
    assert sharding.interleave(docs.where("false"), 24).count() == 0


# 10 ------------------------------------------------------------------------------

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_whole_gapless_and_tight(spark, odd, none):
    docs = odd.unionByName(spark.createDataFrame([(500 + i, prose(i, random.Random(i).randint(1, 3000)), None, None, None) for i in range(80)], SCHEMA))
    got = packing.pack_documents(docs, WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = collections.Counter()
    for d, t in [(r.doc_id, r.text or "") for r in docs.collect()]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[d, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_names_that_clash_with_those_of_operators(spark):
    names = ["shard", "slot", "_bucket", "_digest", "_rank", "_n", "_within", "before", "source", "id", "sequence_id", "offset", "length", "c0"]
    rows = [tuple(1 + (k * 7 + j) % 5 for j in range(len(names))) for k in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` bigint" for n in names))
    dealt = sharding.interleave(df, 3)
    assert dealt.columns == [n for n in names if n not in ("shard", "slot")] + ["shard", "slot"]
    assert sorted(collections.Counter(r.shard for r in dealt.collect()).values()) == [66, 67, 67]
    assert sorted(map(tuple, dealt.drop("shard", "slot").collect())) == sorted(r[2:] for r in rows)
    packed = packing.pack(df, capacity=9)
    assert packed.columns == [n for n in names if n not in ("sequence_id", "offset")] + ["sequence_id", "offset"]
    places = packed.collect()
    assert len({(r.sequence_id, r.offset) for r in places}) == 200 and all(r.offset + r.length <= 9 for r in places)
    for bad in (0, 10, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length int"), capacity=9)


def test_a_cluster_needs_a_named_checkpoint_folder():
    class Context:
        def __init__(self, master):
            self.master, self._jsc, self.folder = master, self, None

        def sc(self):
            return self

        def getCheckpointDir(self):
            class Option:
                isEmpty = staticmethod(lambda: self.folder is None)
                get = staticmethod(lambda: self.folder)

            return Option

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named} if named else {}

    assert common.checkpoint_folder(Session("spark://host:7077", "hdfs://x/shared")) == "hdfs://x/shared"
    assert "tidemark" in common.checkpoint_folder(Session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.checkpoint_folder(Session(master))


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 10_000}, {2049: 7, 2047: 7}, {3000: 500, 1096: 400, 700: 900, 5: 3}, {1400: 10**9, 1296: 10**9}])
def test_plans_place_every_row_once(histogram):
    plan = packing.plan_packing(histogram)
    placed = collections.Counter()
    for length, _, n, _, offset in plan.placements:
        placed[length] += n
        assert 0 <= offset <= 4096 - length
    assert placed == collections.Counter(histogram)
    total = sum(k * n for k, n in histogram.items())
    assert plan.bins >= -(-total // 4096)
    assert plan.bins <= max(sum(histogram.values()), 1)


def test_configurations_are_optimal_on_a_known_case():
    found = packing.fractional_configurations(np.array([50, 30, 20]), np.array([10.0, 20.0, 30.0]), 100, 8)
    assert abs(sum(n for _, n in found) - (50 * 10 + 30 * 20 + 20 * 30) / 100) < 1e-6


# All -----------------------------------------------------------------------------


def test_one_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries())
    assert numbers == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
