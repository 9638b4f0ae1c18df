"""SimHash near-duplicates by segment popcounts, a grid range join and exact checks.

A fingerprint is embedded as the bit counts of its 4-bit segments. One flipped
bit moves one coordinate by one, so the Manhattan distance of two embeddings is
a lower bound of their Hamming distance, and fingerprints within two bits share
a grid point within one step of both. Every distinct fingerprint is posted at its
own grid point and at those one step away; what meets at a point is compared bit
by bit. Only links found there leave a point, as a star for each group, so a group
of many near copies costs rows in proportion to its size. A point that many prints
share is split by the values within one bit of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Rolling
from .common import cut, forget, parts, release, scratch, table, unused
from .components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEGMENTS = 16
RADIUS = 2
#: Prints of a grid point that are compared in one task.
CROWD = 4096
#: For similarity in shingles: words of a shingle, least share of common ones, and keys of a text in the round of leaders.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
KEYS = 16
#: One text in so many tells which shingles are common; at most so many, met so often, are put last in the order.
ORDER_SHARE, ORDER_TIMES, ORDER_MOST = 32, 4, 1 << 17
#: What a task holds at a time: pairs it has found, and texts of a key that are compared with as many others.
PAIRS_AT_ONCE, TILE = 1 << 17, 128
#: Hashes of a list that travels; texts with more are counted pair by pair.
LISTED = 256


def simhash64(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of one text; zero for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = max(1, len(tokens) - words + 1)
    first, last = starts[:take].tolist(), ends[-take:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(first, last)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, take, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > take, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the signed 64 bits of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints = np.array([simhash64(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """(n, 16) bit counts of the 4-bit segments of unsigned fingerprints."""
    shifts = np.arange(0, 64, 64 // SEGMENTS, dtype=np.uint64)
    return np.bitwise_count((prints[:, None] >> shifts) & np.uint64(15)).astype(np.int64)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at its grid point and at every valid point one step away."""
    weight = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        reps = batch.column(1)
        counts = segment_counts(signed.view(np.uint64))
        home = counts @ weight
        rows, cells = [np.arange(len(signed))], [home]
        for axis in range(SEGMENTS):
            for step in (-1, 1):
                there = counts[:, axis] + step
                ok = np.flatnonzero((there >= 0) & (there <= 64 // SEGMENTS))
                rows.append(ok)
                cells.append(home[ok] + step * weight[axis])
        at = np.concatenate(rows)
        cells = np.concatenate(cells)
        for i in range(0, len(at), 1 << 17):
            part = at[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[i : i + (1 << 17)]), pa.array(signed[part]), reps.take(pa.array(part))], ["cell", "fp", "rep"]
            )


def local_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Star edges (index, index) of the groups that links within ``radius`` bits form.

    Small sets are compared pair by pair. Large ones (radius 2) never are: two
    fingerprints are within two bits if and only if they share one of the 65
    values within one bit of each, so equal values are looked for after a sort.
    """
    n = len(prints)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if n <= 512 or radius != 2:
        for i in range(0, n, 256):
            near = np.bitwise_count(prints[i : i + 256, None] ^ prints[None, :]) <= radius
            pairs = np.argwhere(near)
            pairs = pairs[pairs[:, 0] + i < pairs[:, 1]]
            links = ((a + i, b) for a, b in pairs.tolist())
            for a, b in links:
                root[find(b)] = find(a)
    else:
        flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        values = (prints[:, None] ^ flips).ravel()
        order = np.argsort(values, kind="stable")
        same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
        owner = order // len(flips)
        for a, b in set(zip(owner[same].tolist(), owner[same + 1].tolist())):
            root[find(b)] = find(a)
    return [(find(i), i) for i in range(n) if find(i) != i]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among what shares a cell; rows come sorted by cell."""

    def links(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(cell)) + 1
        start = np.concatenate([[0], edge])
        stop = np.concatenate([edge, [len(cell)]])
        two = stop - start == 2
        left = start[two]
        near = np.bitwise_count(fp[left] ^ fp[left + 1]) <= RADIUS
        a, b = [rep[left[near]]], [rep[left[near] + 1]]
        for s, e in zip(start[stop - start > 2].tolist(), stop[stop - start > 2].tolist()):
            pairs = local_links(fp[s:e])
            if pairs:
                i, j = np.array(pairs).T
                a.append(rep[s + i])
                b.append(rep[s + j])
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        part = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        if held is not None:
            part = [np.concatenate([x, y]) for x, y in zip(held, part)]
        if not len(part[0]):
            continue
        last = int(np.searchsorted(part[0], part[0][-1]))  # the last cell may go on
        if last:
            yield links(*[x[:last] for x in part])
        held = [x[last:] for x in part]
    if held is not None and len(held[0]):
        yield links(*held)


def _values_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at itself and at the 64 values one bit away."""
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in parts(batches, 4096):
        near = (batch.column(0).to_numpy().view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(batch.column(1).to_numpy(), len(flips)))], ["value", "rep"])


def crowd_links(prints: DataFrame) -> DataFrame:
    """(a, b): links among (fp, rep) rows of crowded grid points, without bringing a point's prints together.

    Fingerprints within two bits share one of the 65 values within one bit of each, and
    any two that share one are within two bits. So each value's prints are linked to
    the least of them, found with map-side combine.
    """
    near = table(prints.mapInArrow(_values_near, "value bigint, rep bigint"))
    least = (near.groupBy(F.col("value").alias("_value")).agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").drop("c"))
    return near.join(least, near["value"] == least["_value"]).select(F.col("rep").alias("a"), "b").where("a <> b").distinct()


def near_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links among distinct (fp, rep) rows, as stars per grid point; points of more than ``crowd`` prints are split by value."""
    posted = table(prints.mapInArrow(_posted, "cell bigint, fp bigint, rep bigint"))
    crowded = table(posted.groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("_cell"))
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = posted.join(crowded, posted["cell"] == crowded["_cell"], "left_anti")
    links = few.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(_met, "a bigint, b bigint")
    many = posted.join(crowded, posted["cell"] == crowded["_cell"], "left_semi").select("fp", "rep").distinct()
    return links.unionByName(crowd_links(many))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached by links of two or
    fewer differing bits, the row's own included. Rows that repeat an id or a text
    each get a row. Null and wordless texts have fingerprint zero and link like
    any other. A row without an id takes the component of the rows with its
    fingerprint, null if none of those has an id. Only distinct fingerprints are
    compared; copies are joined back at the end by a join that splits hot keys.
    """
    every = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(every.groupBy("fp").agg(F.min("id").cast("bigint").alias("rep")))
    roots = connected_components(near_links(distinct.where("rep is not null")))
    labelled = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id")
    )
    return every.join(labelled, every["fp"] == labelled["_fp"]).select("id", "fp", "component_id")


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text with fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    take = max(1, len(tokens) - words + 1)
    joined = np.frombuffer(b" ".join(tokens), np.uint8)
    return np.unique(Rolling(joined).of((ends - lengths)[:take], ends[-take:]))


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """(id, key): the least shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [shingle_set(t, words)[:KEYS].view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "keys"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, keys array<bigint>")


def _shingles(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the halves of a text's shingle hashes that tell them apart, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [np.unique((shingle_set(t, words) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose (id, text) rows share ``similarity`` of their shingles or more."""
    wanted = table(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct())
    sets = table(_shingles(docs.join(wanted.hint("merge"), docs["id"] == wanted["_id"], "left_semi"), words))
    release(docs.sparkSession.sparkContext)
    mine = pairs.join(sets.hint("merge"), pairs["a"] == sets["id"]).select("a", "b", "shingles")
    other = sets.select(F.col("id").alias("_id"), F.col("shingles").alias("_shingles"))
    both = mine.join(other.hint("merge"), mine["b"] == other["_id"]).select("a", "b", "shingles", "_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            alike = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                common = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(common >= similarity * (len(a) + len(b) - common))
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    alike = table(both.mapInArrow(run, "a bigint, b bigint"))
    forget(sets)
    forget(wanted)
    release(docs.sparkSession.sparkContext)
    return alike


def leader_links(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links of (id, text) rows with the leaders they meet; most links at little cost, not all.

    A fingerprint within two bits sees only changes of a word in a long text: at an
    overlap of 0.8 about ten of 64 bits differ, out of a popcount grid's reach. So
    texts that share one of their 16 least shingle hashes are compared, each with
    one leader for each hash: the text whose hashes are shared most, which is the
    one that others are copies of. There are at most 16 comparisons for each text,
    however large a group is. What is left is for ``crossing_links``.
    """
    posted = table(_keys(docs, words).select("id", F.explode("keys").alias("key")))
    shared = table(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("_key"), "n"))
    met = table(posted.join(shared, posted["key"] == shared["_key"]).select("id", "key", "n"))
    forget(posted)
    forget(shared)
    weight = table(met.groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("weight")))
    weighed = table(met.join(weight, met["id"] == weight["_id"]).select("id", "key", "weight"))
    forget(met)
    forget(weight)
    leaders = table(weighed.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("weight", (-F.col("id")).alias("no"))).alias("top")))
    pairs = weighed.join(leaders, weighed["key"] == leaders["_key"]).select(F.col("id").alias("a"), (-F.col("top.no")).alias("b"))
    wanted = table(pairs.where("a <> b").distinct())
    forget(weighed)
    forget(leaders)
    release(docs.sparkSession.sparkContext)
    return _verified(wanted, docs, words, similarity)


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and how often each was met. They set the order of prefixes; no link depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["key"])

    few = docs.select("id", "text").where(F.pmod(F.xxhash64("id"), F.lit(ORDER_SHARE)) == 0).mapInArrow(run, "key bigint")
    found = few.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ORDER_TIMES).orderBy(F.desc("n"), "key").limit(ORDER_MOST).toArrow()
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy().astype(np.int64)[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes of a set, common ones last, of which a set with that overlap has at least one among its own first."""
    keys, times = common
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        shingles = shingles[np.argsort(np.where(keys[at] == shingles, times[at], 0), kind="stable")]
    return shingles[: len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1] if len(shingles) else shingles


def needed(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """How many hashes the prefixes of sets of x and y hashes share if the sets overlap by ``similarity`` or more.

    They share t / (1 + t) * (x + y) hashes then. Of the prefix that ends first, all but
    what is missing from the other set are in both.
    """
    share = np.ceil(similarity / (1 + similarity) * (x + y) - 1e-6).astype(np.int64)
    beyond = np.ceil(similarity * np.maximum(x, y) - 1e-6).astype(np.int64) - 1
    return np.maximum(share - beyond, 1)


def crossing_pairs(key: int, node: np.ndarray, root: np.ndarray, size: np.ndarray, lists: list[np.ndarray | None], similarity: float) -> Iterator[np.ndarray]:
    """(n, 4) nodes, how many prefix hashes they share, and how many they must, of one key's texts of different roots.

    ``lists`` has all sorted hashes that a text shares with texts of other roots. So a
    pair is counted here, and only where the key is the least that it shares: it is named
    once, if it has enough. A text with a list too long to travel (None) is named with
    every text of its size that it meets, one shared hash at a time.
    """
    order = np.argsort(size, kind="stable")
    node, root, size = node[order], root[order], size[order]
    lists = [lists[i] for i in order.tolist()]
    tile = TILE if len(node) > 12 else len(node)
    for i in range(0, len(node), tile):
        for j in range(i, len(node), tile):
            x, y = np.arange(i, min(i + tile, len(node))), np.arange(j, min(j + tile, len(node)))
            if size[x[-1]] < similarity * size[y[0]] - 1e-6:
                break
            fits = (size[x][:, None] >= similarity * size[y][None, :] - 1e-6) & (root[x][:, None] != root[y][None, :])
            if i == j:
                fits = np.triu(fits, 1)
            if not fits.any():
                continue
            shared, least = _shared([lists[k] for k in x.tolist()], [lists[k] for k in y.tolist()], key)
            at, to = np.nonzero(fits & least)
            one, other = x[at], y[to]
            need, n = needed(size[one], size[other], similarity), shared[at, to]
            # Hashes are cut to 32 bits, so two of a text can fall together: one fewer is enough to be looked at.
            good = (n == 0) | (n >= need - 1)
            one, other, need, n = one[good], other[good], need[good], n[good]
            if len(one):
                low, high = np.minimum(node[one], node[other]), np.maximum(node[one], node[other])
                yield np.stack([low, high, np.where(n == 0, 1, np.maximum(n, need)), need], axis=1)


def _shared(x: list[np.ndarray | None], y: list[np.ndarray | None], key: int) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each two lists share, 0 where one is None; and whether none of them is less than ``key``."""
    if len(x) * len(y) <= 64:
        n, least = np.zeros((len(x), len(y)), np.int64), np.ones((len(x), len(y)), bool)
        mine, theirs = ([None if v is None else set(v.tolist()) for v in part] for part in (x, y))
        for i, a in enumerate(mine):
            for j, b in enumerate(theirs):
                if a is not None and b is not None:
                    both = a & b
                    n[i, j], least[i, j] = len(both), min(both, default=key) >= key
        return n, least
    lengths = [0 if v is None else len(v) for v in (*x, *y)]
    every, column, times = np.unique(np.concatenate([v for v in (*x, *y) if v is not None] or [np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    some = times[column] > 1
    place = np.cumsum(times > 1) - 1
    has = np.zeros((len(lengths), int((times > 1).sum())), np.float32)
    has[row[some], place[column[some]]] = 1
    before = int(np.searchsorted(every[times > 1], key))
    a, b = has[: len(x)], has[len(x) :]
    return np.rint(a @ b.T).astype(np.int64), (a[:, :before] @ b[:, :before].T) < 0.5


def crossing_links(docs: DataFrame, roots: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): all verified links of (id, text) rows that ``roots`` (node, root) has in different groups.

    Exact: hashes are ordered with common ones last, and each text is posted at all
    of its first ones (a fifth of its shingles and one, at 0.8), so any two texts
    with the overlap meet. Hashes that only texts of one group have are dropped; to
    the others a text goes with the list of them, so that what meets is counted there
    and only pairs that share as many as the overlap asks for leave, once. Nothing is
    capped: that many texts of different groups share a hash costs the time to compare
    them, tile by tile, but no rows.
    """
    common = _common_shingles(docs, words)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for node, root, text in zip(*[c.to_pylist() for c in batch.columns]):
                every = shingle_set(text, words)
                first = prefix(every, common, similarity)
                cols = [first.view(np.int64), *(np.full(len(first), v, np.int64) for v in (node, root, len(every)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "root", "size"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for node, root, size, keys in zip(*batch.columns):
                own = np.sort(keys.values.to_numpy()) if keys.is_valid else np.zeros(0, np.int64)
                held = None if len(own) > LISTED else np.unique(own >> 32).astype("<i4").tobytes()
                n = len(own)
                cols = [pa.array(own), *(pa.array(np.full(n, v.as_py(), np.int64)) for v in (node, root, size)), pa.array([held] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "node", "root", "size", "list"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> Iterator[np.ndarray]:
            if len(rows) < 2 or len({r[2] for r in rows}) < 2:
                return
            node, root, size = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            lists = [None if r[4] is None else np.frombuffer(r[4], "<i4").astype(np.int64) for r in rows]
            yield from crossing_pairs(rows[0][0] >> 32, node, root, size, lists, similarity)

        def packed(out: list[np.ndarray]) -> pa.RecordBatch:
            every = np.ascontiguousarray(np.concatenate(out).T)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in every], ["a", "b", "n", "need"])

        rows: list[tuple] = []
        out: list[np.ndarray] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and rows[0][0] != row[0]:
                    for pairs in found(rows):
                        out.append(pairs)
                        if sum(map(len, out)) >= PAIRS_AT_ONCE:
                            yield packed(out)
                            out = []
                    rows = []
                rows.append(row)
        for pairs in found(rows):
            out.append(pairs)
        if out:
            yield packed(out)

    rooted = docs.join(roots.hint("merge"), docs["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"), "text")
    posted = table(rooted.mapInArrow(post, "key bigint, node bigint, root bigint, size bigint"))
    release(docs.sparkSession.sparkContext)  # the texts went through an exchange
    several = posted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    kept = table(several.select(F.col("key").alias("_key")))
    crossing = table(posted.join(kept, F.col("key") == F.col("_key")).drop("_key"))
    forget(posted)
    forget(kept)
    release(docs.sparkSession.sparkContext)
    lists = crossing.groupBy("node", "root", "size").agg(F.collect_list("key").alias("keys"))
    rows = lists.mapInArrow(listed, "key bigint, node bigint, root bigint, size bigint, list binary")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint, n bigint, need bigint")
    enough = met.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need")
    pairs = table(enough.select("a", "b"))
    forget(crossing)
    release(docs.sparkSession.sparkContext)
    return _verified(pairs, docs, words, similarity)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row for each group of near copies: that with the smallest id.

    Groups are linked by fingerprints within two bits and, with ``similarity``, by
    every two texts whose shingles overlap by that much. Rows without an id are kept.
    Rows alike in id and text stay or go together; rows that share an id but not a text
    are told apart. Columns of ``docs`` keep their names and values.
    """
    with scratch() as keep:
        rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
        marks = rows.groupBy(F.col("id").alias("_shared")).agg(F.min(F.xxhash64("text")).alias("_first"), F.max(F.xxhash64("text")).alias("_last"))
        shared = keep(table(marks.where("_first < _last").drop("_last")))
        known = _noded(rows, "id", "text", shared, "node").select(F.col("node").alias("id"), "text")
        every = table(fingerprints(known, "id", "text", words))
        distinct = table(every.groupBy("fp").agg(F.min("id").alias("rep")))
        links = near_links(distinct)
        if similarity is not None:
            # One row for each text; texts with one fingerprint can differ, so each is linked to the fingerprint's own.
            texts = table(known.groupBy(F.xxhash64("text"), F.length("text")).agg(F.min("id").alias("_rep")).select("_rep").distinct())
            first = table(known.join(texts.hint("merge"), known["id"] == texts["_rep"], "left_semi"))
            release(docs.sparkSession.sparkContext)
            same = every.join(texts, every["id"] == texts["_rep"], "left_semi").join(distinct.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"))
            links = links.unionByName(same.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
            links = links.unionByName(leader_links(first, similarity=similarity))
        roots = connected_components(links)
        if similarity is not None:
            rest = crossing_links(first, roots, similarity=similarity)
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))
        labelled = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id"))
        groups = every.join(labelled, every["fp"] == labelled["_fp"])
        gone = keep(table(groups.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone")).distinct()))
    node = unused(docs, "_node")
    marked = _noded(docs, id_col, text_col, shared, node)
    return marked.join(gone.hint("merge"), marked[node] == gone["_gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _noded(docs: DataFrame, id_col: str, text_col: str, shared: DataFrame, name: str) -> DataFrame:
    """``docs`` with its id as ``name``, but for texts after the first of an id in ``shared``: those get a number beyond any id."""
    number = F.col(f"`{id_col}`").cast("bigint")
    if shared.isEmpty():
        return docs.withColumn(name, number)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    beyond = F.lit(1 << 62) + F.xxhash64(number, mark).bitwiseAND((1 << 61) - 1)
    own = F.when(F.col("_first") != mark, beyond).otherwise(number)
    return docs.join(shared.hint("merge"), number == F.col("_shared"), "left").select(*kept, own.alias(name))
