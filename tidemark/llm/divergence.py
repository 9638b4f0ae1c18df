"""How far the sources of a language are from each other, over the words that the language keeps.

Words are counted for each (language, source). A language keeps those that stand in at
least ``LEAST`` of its documents. A group gives a kept word, with c of its N kept
occurrences and V kept words in the language, the weight p = 1 + floor(SCALE * (c + 1) /
(N + V)); against weights q it diverges by the sum of floor((p - q)**2 / q). All is
exact in 64-bit integers.

Words are cut into slices by hash; a group's vector in a slice is one compressed row of
word numbers and counts. The groups of a language are dealt to ``BLOCKS`` blocks, and a
block in a slice stays in its partition. In the rounds of a tournament in which every
block meets every other once, the vectors of one block travel to the home of its
partner; a meeting gives both directions of every pair at once. Round 0 is the block
with itself. Sums over slices follow. Words are ranked where their slice is: a heap of
``TERMS`` for each group, and the heaps of slices are merged at the end.

A meeting holds two blocks of one slice, and slices grow in number with the vectors, so
memory does not grow with sources or words. A word that stands in neither vector of a
pair adds a constant, which is counted and not made. A source with most documents is
counted with map-side combine, and has no more in a slice than the slice has words.

A null text, language or source is an empty string. A text without words has a group
all the same; a group without kept words diverges by its even weights. An empty table
gives no rows. Only the three columns are read, whatever others there are.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, forget, parts, table

LEAST = 3
SCALE = 1_000_000_000
TERMS = 200
BLOCKS = 8
#: Kept (group, word) counts in a slice.
PER_SLICE = 100_000
#: Counts that a task holds before it hands them on, and rows that it hands on together.
HELD, ROWS_AT_ONCE = 1_000_000, 1 << 16
COUNTS = ["lang", "source", "term", "n", "docs"]
#: Bits of a word's number, below that of its group or text.
WORD_BITS = 32
#: A-Z lower-cased, and a space for each byte of ASCII that is no letter.
FOLDED = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, with A-Z lower-cased; a character beyond ASCII has no byte below 128."""
    return text.translate(FOLDED).split()


def counted(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text) batches; each group and word once for about ``held`` of them.

    Words and groups are numbered as they come, and counted as numbers.
    """
    groups: defaultdict[tuple, int] = defaultdict(count().__next__)
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    sums: list[np.ndarray] = []

    def added(parts: list[np.ndarray]) -> np.ndarray:
        """(3, n): group and word in one number, n and docs, summed for each number."""
        key, n, docs = np.concatenate(parts, axis=1)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        return np.stack([key[order][start], *(np.add.reduceat(x[order], start) if len(start) else x for x in (n, docs))])

    def handed_on() -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(x, pa.string()) for x in zip(*groups))
        own = np.arange(len(groups), dtype=np.int64)
        terms = pa.array(numbers, pa.binary()).cast(pa.string())
        none = np.zeros(len(own), np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(own), pa.string()), pa.array(none), pa.array(none)], COUNTS)
        key, n, docs = added(sums)
        for at in range(0, len(key), ROWS_AT_ONCE):
            some = slice(at, at + ROWS_AT_ONCE)
            group, word = pa.array(key[some] >> WORD_BITS), pa.array(key[some] & ((1 << WORD_BITS) - 1))
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(word), pa.array(n[some]), pa.array(docs[some])], COUNTS)
        sums.clear()
        for numbering in (groups, numbers):
            numbering.clear()
            numbering.default_factory = count().__next__

    for batch in parts(batches):
        texts = [words(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        group = np.fromiter((groups[g] for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), np.int64, len(texts))
        word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        # A text's words first, as each text counts once for its documents.
        mine, n = np.unique((np.repeat(np.arange(len(texts)), sizes) << WORD_BITS) | word, return_counts=True)
        key = (group[mine >> WORD_BITS] << WORD_BITS) | (mine & ((1 << WORD_BITS) - 1))
        sums.append(added([np.stack([key, n, np.ones(len(key), np.int64)])]))
        if sum(x.shape[1] for x in sums) > held * 3 // 2:
            sums[:] = [added(sums)]
            if sums[0].shape[1] > held:
                yield from handed_on()
    if groups:
        yield from handed_on()


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the word; a row with a null term for each group."""
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    held = HELD
    found = given.mapInArrow(lambda batches: counted(batches, held), "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _press(places: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(places, prepend=0).astype(np.uint32)
    return zlib.compress(steps.tobytes() + counts.astype(np.int64).tobytes(), 1)


def _unpress(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if blob is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.int64)), np.frombuffer(raw, np.int64, n, 4 * n)


VECTORS = "lang string, slice int, source string, size bigint, total bigint, vector binary, terms binary"


def _vectors(kept: DataFrame) -> DataFrame:
    """A compressed row for each group and slice; the row without a source is the language's, with the words themselves."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("source", "ascending"), ("term", "ascending")])
        terms, place = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True)
        counts = rows["n"].to_numpy()
        whole = np.zeros(len(terms), np.int64)
        np.add.at(whole, place, counts)
        lang, part, size = key[0].as_py(), key[1].as_py(), len(terms)
        listed = zlib.compress("\x00".join(terms).encode(), 1)
        out = [(lang, part, None, size, int(whole.sum()), _press(np.arange(size), whole), listed)]
        sources = rows["source"].to_pylist()
        starts = [0, *(k for k in range(1, len(sources)) if sources[k] != sources[k - 1]), len(sources)]
        for a, b in zip(starts, starts[1:]):
            out.append((lang, part, sources[a], size, int(counts[a:b].sum()), _press(place[a:b], counts[a:b]), None))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split(" ")[0] for x in VECTORS.split(", ")])

    return kept.groupBy("lang", "slice").applyInArrow(pack, VECTORS)


def weights(counts: np.ndarray | int, whole: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (c + 1) / (whole + size)), in three steps of long division so that no product leaves 64 bits."""
    rest, by, found = np.asarray(counts, np.int64) + 1, np.int64(whole + size), np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // by
        rest = rest % by
    return found + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Group:
    """A group's vector in a slice, unpacked."""

    def __init__(self, row: dict) -> None:
        self.source = row["source"]
        self.places, self.counts = _unpress(row["vector"])
        self.even = int(weights(0, row["whole"], row["words"])) if row["words"] else 0
        self.given = weights(self.counts, row["whole"], row["words"]) if len(self.counts) else self.counts

    def over(self, size: int) -> np.ndarray:
        dense = np.full(size, self.even, np.int64)
        dense[self.places] = self.given
        return dense


def _meetings(residents: list[dict], peers: list[dict], itself: bool) -> list[tuple[str, str, int]]:
    """(source, item, value) in both directions for each resident and peer of a slice."""
    size, found = residents[0]["size"], []
    here, there = [_Group(r) for r in residents], [_Group(r) for r in peers]
    lines = {b.source: b.over(size) for b in there}
    for k, a in enumerate(here):
        mine = a.over(size)
        for b in there[k + 1 :] if itself else there:
            met = np.union1d(a.places, b.places)
            p, q, rest = mine[met], lines[b.source][met], size - len(met)
            for one, other, x, y, u, v in ((a, b, p, q, a.even, b.even), (b, a, q, p, b.even, a.even)):
                value = int(divergence(x, y).sum()) + (rest * ((u - v) ** 2 // v) if rest else 0)
                found.append((one.source, other.source, value))
    return found


def partners(blocks: int, number: int) -> dict[int, int]:
    """Guest block -> home block in a round from 1 to ``blocks`` - 1; each pair of blocks meets in exactly one."""
    ring = [0, *((k + number) % (blocks - 1) + 1 for k in range(blocks - 1))]
    pairs = [(ring[k], ring[blocks - 1 - k]) for k in range(blocks // 2)]
    return {(b if number % 2 else a): (a if number % 2 else b) for a, b in pairs}


def _rounds(residents: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, item, value) of each slice, over all rounds. All rounds use the one exchange of the residents."""
    shape = "lang string, source string, item string, value bigint"
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    home = residents.groupBy("lang", "slice", "block")

    def rows(lang: str, met: list[tuple]) -> pa.Table:
        columns = zip(*((lang, *m) for m in met)) if met else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value"])

    def within(key: tuple, mine: pa.Table) -> pa.Table:
        listed = mine.to_pylist()
        return rows(key[0].as_py(), _meetings(listed, listed, True))

    def meet(key: tuple, mine: pa.Table, guests: pa.Table) -> pa.Table:
        both = mine.num_rows and guests.num_rows
        return rows(key[0].as_py(), _meetings(mine.to_pylist(), guests.to_pylist(), False) if both else [])

    rounds = [home.applyInArrow(within, shape)]
    for number in range(1, blocks):
        to = partners(blocks, number)
        host = F.element_at(F.create_map(*[F.lit(x) for pair in to.items() for x in pair]), F.col("block"))
        travelling = residents.where(F.col("block").isin(*to)).withColumn("block", host)
        rounds.append(home.cogroup(travelling.groupBy("lang", "slice", "block")).applyInArrow(meet, shape))
    return reduce(DataFrame.unionByName, rounds)


def _ranked_terms(vectors: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value): for each group and slice, the ``most`` words that it has more of than its language."""
    shape = "lang string, source string, item string, value bigint"

    def rank(key: tuple, rows: pa.Table) -> pa.Table:
        listed = rows.to_pylist()
        whole = next(r for r in listed if r["source"] is None)
        terms = zlib.decompress(whole["terms"]).decode().split("\x00")
        usual, out = _Group(whole).over(whole["size"]), []
        for row in listed:
            if row["source"] is None:
                continue
            group = _Group(row)
            q = usual[group.places]
            more = group.given > q
            value = divergence(group.given[more], q[more])
            best = heapq.nsmallest(most, zip((-value).tolist(), (terms[k] for k in group.places[more])))
            out += [(key[0].as_py(), group.source, term, -v) for v, term in best]
        columns = zip(*out) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()])], names=["lang", "source", "item", "value"])

    return vectors.groupBy("lang", "slice").applyInArrow(rank, shape)


def audit(docs: DataFrame, least: int = LEAST, terms: int = TERMS, blocks: int = BLOCKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source is ("pair"), and the ``terms`` words that stand out ("term").

    ``blocks``: an even number; more blocks make meetings smaller and rounds more.
    """
    if blocks < 2 or blocks % 2:
        raise ValueError(f"blocks must be even and at least 2, not {blocks}")
    counts = table(count_words(docs))
    usual = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= least)
    usual = usual.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"))
    kept = counts.join(usual.hint("merge"), (counts["lang"] == usual["_lang"]) & (counts["term"] == usual["_term"]), "left_semi")
    slices = buckets_for(counts.count(), PER_SLICE)
    sliced = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"))
    vectors = table(_vectors(sliced))
    named = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("whole"))
    langs = vectors.where("source is null").groupBy("lang").agg(F.sum("size").alias("words"), F.sum("total").alias("all"))
    groups = counts.where("term is null").select("lang", "source").join(named, ["lang", "source"], "left").join(langs.drop("all"), "lang", "left")
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    groups = table(groups.select("lang", "source", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("words", F.lit(0)).alias("words"), block))
    forget(counts)

    sizes = vectors.where("source is null").select("lang", "slice", "size")
    places = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(sizes, ["lang", "slice"], "left")
    mine = vectors.where("source is not null").select("lang", "slice", "source", "vector")
    residents = table(places.join(mine, ["lang", "slice", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0))))

    pairs = _rounds(residents, blocks).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    with_sums = vectors.where("source is not null").join(groups.drop("block"), ["lang", "source"]).select("lang", "slice", "source", "size", "vector", "terms", "whole", "words")
    language = vectors.where("source is null").join(langs, "lang").select("lang", "slice", "source", "size", "vector", "terms", F.col("all").alias("whole"), "words")
    best = _ranked_terms(with_sums.unionByName(language), terms)

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms).withColumn("part", F.lit("term"))
    return pairs.select(columns).unionByName(best.select(columns))
