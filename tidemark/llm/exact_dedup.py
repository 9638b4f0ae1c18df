"""Exact removal of repeated texts against a history of distinct digests.

Texts are equal when they are identical after each run of blanks became one space.
The history is an index: its distinct digests (SHA-256 of such texts) are dealt to
shards by their bits, and a shard holds a minimal perfect hash of its digests and, slot
by slot, the full digest, the row that stays (its locator) and how many rows have it. A
new delivery is first counted by digest, with map-side combine; each of its digests
goes to its shard, where the hash names one slot and all 32 bytes there are compared.
Digests that stand there are repeats of the row that the slot names; the others group
among themselves. Last, texts of repeats are compared with the text of the row that
stays, byte by byte; texts that only share a digest are grouped by their bytes.

A shard has about ``PER_SHARD`` distinct digests whatever the copies, so none is hot.
Rows get their group's result by a join in which the few digests that hold more than a
``HOT``-th of the rows each, fewer than ``HOT`` of them, are broadcast. Texts of a large
group are compared in parts of ``PER_PART`` rows, each with a copy of the one text.

Nulls: a null text is an empty one; rows with a null id count and come out, and stay
only where no row of the group has an id. Of rows alike in id and text one stays. An
empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix
from .common import buckets_for, forget, join_counted, table

PER_SHARD = 20_000
PER_PART = 1_000
LEVELS = 32
BYTES = 32

Digest = Callable[[Column], Column]

GROUPS = "digest binary, id bigint, place bigint, n bigint"
INDEX = "shard int, sizes array<int>, marks binary, rest binary, digests binary, ids array<bigint>, places array<bigint>, counts array<bigint>"


def normalised(text: Column | str) -> Column:
    """The text with each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte keys.

    On each level a key that has a bit of its own marks it; the others go on to the
    next, smaller level. A key's slot is the number of marks before its own. Keys left
    after the last level, of which there are next to none, are listed.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.before = [np.cumsum(marks) - marks for marks in levels]
        ends = np.cumsum([0, *(int(marks.sum()) for marks in levels)])
        self.starts, self.placed = ends[:-1], int(ends[-1])

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        words = keys.view(np.uint64).reshape(len(keys), BYTES // 8)
        mixed = np.full(len(keys), np.uint64(2 * level + 1))
        for k in range(words.shape[1]):
            mixed = mix(mixed ^ words[:, k])
        return (mixed % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct rows of 32 bytes."""
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = 2 * len(left)
            bit = cls._bit(left, len(levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[bit]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or the slot of another, for keys it was not made of."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, marks in enumerate(self.levels):
            bit = self._bit(keys[open_], level, len(marks))
            here = marks[bit]
            found[open_[here]] = self.starts[level] + self.before[level][bit[here]]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            listed = {key.tobytes(): self.placed + k for k, key in enumerate(self.rest)}
            found[open_] = [listed.get(key.tobytes(), -1) for key in keys[open_]]
        return found

    def packed(self) -> dict:
        bits = b"".join(np.packbits(marks).tobytes() for marks in self.levels)
        return {"sizes": [len(marks) for marks in self.levels], "marks": bits, "rest": self.rest.tobytes()}

    @classmethod
    def unpacked(cls, sizes: list[int], marks: bytes, rest: bytes) -> PerfectHash:
        bits, at, levels = np.frombuffer(marks, np.uint8), 0, []
        for size in sizes:
            end = at + -(-size // 8)
            levels.append(np.unpackbits(bits[at:end], count=size).astype(bool))
            at = end
        return cls(levels, np.frombuffer(rest, np.uint8).reshape(-1, BYTES))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _shape(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _in_shards(groups: DataFrame, shards: int) -> DataFrame:
    """By the first seven bytes of the digest."""
    return groups.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint"), F.lit(shards)).cast("int"))


def counted(rows: DataFrame) -> DataFrame:
    """(digest, id, place, n): distinct digests of (id, digest, place), the first row by id, null last, and how many there are."""
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "place")).alias("first")
    return rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).select("digest", "first.id", "first.place", "n")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The history of ``groups`` (as of ``counted``): a row for each shard that has any."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys = _keys(rows["digest"])
        made = PerfectHash.of(keys)
        order = np.argsort(made.slots(keys))
        held = rows.take(pa.array(order))
        row = made.packed() | {"shard": key[0].as_py(), "digests": keys[order].tobytes()}
        row |= {"ids": held["id"].to_pylist(), "places": held["place"].to_pylist(), "counts": held["n"].to_pylist()}
        return pa.Table.from_pylist([row], _shape(INDEX))

    return _in_shards(groups, shards).groupBy("shard").applyInArrow(build, INDEX)


def look_up(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Groups of the history and the delivery together, with ``known`` where the history has the digest.

    A known digest keeps the history's row and adds up the counts.
    """
    shape = f"{GROUPS}, known boolean"

    def meet(key: tuple, held: pa.Table, new: pa.Table) -> pa.Table:
        if not held.num_rows:
            return new.select(["digest", "id", "place", "n"]).append_column("known", pa.array([False] * new.num_rows, pa.bool_())).cast(_shape(shape))
        slots = held.to_pylist()[0]
        digests = np.frombuffer(slots["digests"], np.uint8).reshape(-1, BYTES)
        keys = _keys(new["digest"])
        at = PerfectHash.unpacked(slots["sizes"], slots["marks"], slots["rest"]).slots(keys)
        same = (at >= 0) & (digests[at] == keys).all(axis=1) if len(keys) else np.zeros(0, bool)
        counts = np.array(slots["counts"], np.int64)
        np.add.at(counts, at[same], new["n"].to_numpy()[same])
        mine = [digests[k].tobytes() for k in range(len(digests))], slots["ids"], slots["places"], counts, [True] * len(digests)
        old = pa.table([pa.array(c, f.type) for c, f in zip(mine, _shape(shape))], schema=_shape(shape))
        apart = new.select(["digest", "id", "place", "n"]).filter(pa.array(~same))
        return pa.concat_tables([old, apart.append_column("known", pa.array([False] * apart.num_rows, pa.bool_())).cast(_shape(shape))])

    return index.groupBy("shard").cogroup(_in_shards(groups, shards).groupBy("shard")).applyInArrow(meet, shape)


def _only_alike(texts: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """(digest): digests that different texts share. ``texts``: (id, digest, text); ``repeated``: groups of more than one row."""
    parts = F.ceil(F.col("n") / PER_PART).cast("int").alias("parts")
    met = table(join_counted(texts, repeated.select("digest", F.col("id").alias("_first"), "n", parts), ["digest"], "n", total, "inner").drop("n"))
    first = F.col("id").eqNullSafe(F.col("_first"))
    stays = met.where(first).groupBy("digest", "parts").agg(F.min("text").alias("_least"), F.max("text").alias("_most"))
    spread = stays.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = met.where(~first).select("digest", "text", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("parts")).cast("int").alias("part"))
    differs = others.hint("merge").join(spread, ["digest", "part"]).where((F.col("text") != F.col("_least")) | (F.col("text") != F.col("_most")))
    odd = table(differs.select("digest").unionByName(stays.where(F.col("_least") != F.col("_most")).select("digest")).distinct())
    forget(met)
    return odd


def _by_bytes(texts: DataFrame) -> DataFrame:
    """The result of rows whose digests tell texts apart no more; they are grouped by their texts."""
    placed = table(texts.withColumn("place", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "place")).alias("first")
    groups = placed.groupBy("text").agg(first, F.count(F.lit(1)).alias("n")).select("text", F.col("first.id").alias("keep_id"), F.col("first.place").alias("_place"), "n")
    return placed.join(groups, "text").select("id", "keep_id", F.col("n").alias("group_size"), (F.col("place") == F.col("_place")).alias("kept"), "digest")


def find_repeats(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, digest): a row for each row of ``history`` and ``docs``.

    ``history`` are rows that came before: of equal texts one of them stays, that with
    the smallest id. Where it is None, the rows of ``docs`` with ids in the lower half of
    their range are the history of the others, so that the smallest id of all stays.
    """

    def read(df: DataFrame) -> DataFrame:
        text = normalised(F.col(f"`{text_col}`"))
        return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), digest(text).alias("digest"), text.alias("text"))

    if history is None:
        ends = docs.agg(F.min(f"`{id_col}`"), F.max(f"`{id_col}`")).first()
        middle = 0 if ends[0] is None else (int(ends[0]) + int(ends[1])) // 2
        texts = read(docs)
        earlier = F.coalesce(F.col("id") <= middle, F.lit(False))
    else:
        texts = read(history).withColumn("earlier", F.lit(True)).unionByName(read(docs).withColumn("earlier", F.lit(False)))
        earlier = F.col("earlier")
    rows = table(texts.select("id", "digest", earlier.alias("earlier"), F.monotonically_increasing_id().alias("place")))
    held, new = counted(rows.where("earlier")), counted(rows.where("not earlier"))
    total = rows.count()
    shards = buckets_for(total, PER_SHARD)
    index = table(build_index(held, shards))
    groups = table(look_up(index, new, shards))
    forget(index)
    repeated = groups.where("n > 1")
    odd = _only_alike(texts.select("id", "digest", "text"), repeated, total)
    mine = join_counted(rows, repeated.select("digest", F.col("id").alias("_keep"), F.col("place").alias("_place"), "n"), ["digest"], "n", total, "left")
    found = mine.select(
        "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("n").isNull() | (F.col("place") == F.col("_place"))).alias("kept"), "digest",
    )
    if odd.isEmpty():
        return found
    collided = _by_bytes(texts.select("id", "digest", "text").join(odd, "digest", "left_semi"))
    return found.join(odd, "digest", "left_anti").select(*collided.columns).unionByName(collided)
