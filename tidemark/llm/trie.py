"""A trie of conversation prefixes, with leaves and shared code points summed over subtrees.

A node is a distinct sequence of first turns, and its key is a digest of them: the
exclusive or of a hash of each turn with its place. Keys of prefixes come from a running
one over a conversation, cut into stretches of ``STRETCH`` turns with what came before
each, so a conversation of any length has no task of its own. A node's parent key is its
own without its last turn. That a key stands for one sequence is checked: all rows of a
node must have one depth, one parent key and one last turn (by 120 bits of its SHA-256).

Sums over subtrees double their reach in each round: a node holds a pointer to its
ancestor at distance 2**r and the sums over what is less than 2**r below it. It hands
its sums to that ancestor and takes over the ancestor's pointer. Rounds grow with the
logarithm of the deepest node, and a node leaves once its pointer is past the root.

Nodes with many members, children or ends are counted with map-side combine; joins on
them go by ``join_counted``. Numbers of the conversations that end at one node are joined
into pieces of ``PIECE`` in order, over all tasks, and the digest runs over the pieces.

Turns are in order of ``turn``, null first, and of ties by the digest of role and text.
A null role or text is empty. Rows without a conversation are left out. An empty table
gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, join_counted, numbered, table

STRETCH = 4096
PIECE = 2000
SHARED = 6
FAMILY = 100
KEY = ["k1", "k2"]
UP = ["a1", "a2"]


def _half(hexed: Column, at: int) -> Column:
    return F.conv(F.substring(hexed, at, 15), 16, 10).cast("bigint")


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv, own, c1, c2, chars): numbered turns, each with a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.char_length(text).cast("bigint").alias("chars"), digest.alias("digest")
    )
    bucket = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60)))
    slim = turns.select("conv", "turn", "chars", _half(F.col("digest"), 1).alias("c1"), _half(F.col("digest"), 16).alias("c2"), bucket.alias("bucket"))
    order = [F.col("turn").asc_nulls_first(), F.col("c1"), F.col("c2")]
    return numbered(table(slim), ["conv"], "bucket", order, "own").select("conv", "own", "c1", "c2", "chars")


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from that which leads its family."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, c1, c2, chars, last) and conversations (conv, length) after the exchange of first turns."""
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("shared", shared_turns(F.col("conv"))).withColumn("lead", F.col("conv") - F.col("conv") % FAMILY)
    leads = convs.where(F.col("conv") == F.col("lead")).select(F.col("conv").alias("lead"), F.col("n").alias("lead_n"))
    head = F.least("shared", F.coalesce("lead_n", F.lit(0)))
    sized = convs.join(leads, "lead", "left").withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    sized = table(sized.select("conv", "lead", "n", "shared", "head", "length"))
    first = own.where((F.col("conv") % FAMILY == 0) & (F.col("own") < SHARED)).withColumnRenamed("conv", "lead")
    taken = sized.where("head > 0").select("conv", "lead", "head", "length").join(first, "lead").where(F.col("own") <= F.col("head"))
    total = own.count()
    mine = join_counted(own, sized.select("conv", "n", "shared", "head", "length"), ["conv"], "n", total, "inner").where(F.col("own") > F.col("shared"))
    columns = ["conv", "depth", "c1", "c2", "chars", (F.col("depth") == F.col("length")).alias("last")]
    turns = taken.withColumn("depth", F.col("own")).select(*columns)
    return turns.unionByName(mine.withColumn("depth", F.col("own") - F.col("shared") + F.col("head")).select(*columns)), sized.select("conv", "length")


def keyed(turns: DataFrame) -> DataFrame:
    """Turns with the key of the sequence that they end (``KEY``) and of what is before them (``UP``)."""
    mixed = turns.withColumn("m1", F.xxhash64(F.lit(1), "depth", "c1", "c2")).withColumn("m2", F.xxhash64(F.lit(2), "c2", "depth", "c1"))
    cut = table(mixed.withColumn("stretch", F.floor(F.col("depth") / STRETCH)))
    within = W.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    running = cut.withColumns({"k1": F.bit_xor("m1").over(within), "k2": F.bit_xor("m2").over(within)})
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("conv", "stretch").agg(F.bit_xor("m1").alias("t1"), F.bit_xor("m2").alias("t2"))
    carried = sums.withColumns({"b1": F.bit_xor("t1").over(before), "b2": F.bit_xor("t2").over(before)}).where("stretch > 0").select("conv", "stretch", "b1", "b2")
    later = running.where("stretch > 0").join(carried, ["conv", "stretch"])
    later = later.withColumn("k1", F.col("k1").bitwiseXOR(F.col("b1"))).withColumn("k2", F.col("k2").bitwiseXOR(F.col("b2"))).drop("b1", "b2")
    every = running.where("stretch = 0").unionByName(later)
    return every.select(
        "conv", "depth", "c1", "c2", "chars", "last", "k1", "k2", F.col("k1").bitwiseXOR(F.col("m1")).alias("a1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("a2")
    )


def _nodes(rows: DataFrame) -> DataFrame:
    """A row for each key; an error where a key would stand for two sequences."""
    same = ["depth", "a1", "a2", "c1", "c2"]
    ended = F.when(F.col("last"), F.col("conv"))
    nodes = table(
        rows.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.count(ended).alias("n_ends"), F.min(ended).alias("end"),
            *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"_{c}") for c in same],
        )
    )
    unlike = " or ".join(f"{c} <> _{c}" for c in same)
    if not nodes.where(unlike).isEmpty():
        raise ValueError("two sequences of turns have one key")
    return nodes.drop(*[f"_{c}" for c in same])


def _roll_up(nodes: DataFrame) -> DataFrame:
    """(UP, leaves, saved): what each node gets from all nodes below it."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = table(nodes.where("depth > 0").select(*KEY, *UP, "depth", "leaves", "saved"))
    given, step = [], 1
    while step <= deepest:
        sums = table(active.groupBy(*UP).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n")))
        given.append(sums)
        if 2 * step > deepest:
            forget(active)
            break
        to_me = sums.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"), "n")
        further = active.where(F.col("depth") >= 2 * step)
        own = further.join(to_me.drop("n"), KEY, "left").select(
            *KEY, *UP, "depth", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")
        )
        above = active.join(to_me.select(*KEY, "n"), KEY).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"), "n")
        moved = join_counted(own, above, UP, "n", active.count(), "inner")
        ahead = table(moved.select(*KEY, F.col("n1").alias("a1"), F.col("n2").alias("a2"), "depth", "leaves", "saved"))
        forget(active)
        active, step = ahead, 2 * step
    if not given:
        return active.select(*UP, "leaves", "saved")
    every = given[0]
    for more in given[1:]:
        every = every.unionByName(more)
    return every.groupBy(*UP).agg(F.sum("leaves").alias("below"), F.sum("saved").alias("saved_below"))


def _pieces(ends: DataFrame) -> DataFrame:
    """(KEY, first, piece): numbers of the conversations that end at a node, in order, ``PIECE`` in a row."""
    shape = "k1 bigint, k2 bigint, first bigint, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def piece() -> pa.RecordBatch:
            row = [key[0]], [key[1]], [held[0]], [",".join(map(str, held))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, [pa.int64()] * 3 + [pa.string()])], ["k1", "k2", "first", "piece"])

        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (key != (k1, k2) or len(held) == PIECE):
                    yield piece()
                    held = []
                key = k1, k2
                held.append(conv)
        if held:
            yield piece()

    return ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(run, shape)


def _digests(pieces: DataFrame) -> DataFrame:
    """(KEY, ends): SHA-256 of a node's pieces, joined by commas, a piece at a time."""
    shape = "k1 bigint, k2 bigint, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done(keys: list[tuple]) -> pa.RecordBatch:
            columns = zip(*keys) if keys else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string()])], ["k1", "k2", "ends"])

        for batch in batches:
            out = []
            for k1, k2, piece in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if key != (k1, k2):
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(piece.encode())
                else:
                    digest.update(f",{piece}".encode())
            yield done(out)
        if key is not None:
            yield done([(*key, digest.hexdigest())])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(run, shape)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    Conversations are rebuilt first: each takes its first turns, up to five by its number,
    from the one that leads its family of a hundred.
    """
    own = table(own_turns(conversations))
    turns, convs = rebuilt(own)
    rows = table(keyed(turns))
    zero = [F.lit(0).cast("bigint").alias(c) for c in (*KEY, *UP, "depth", "c1", "c2", "chars")]
    root = convs.select("conv", (F.col("length") == 0).alias("last"), *zero)
    every = rows.unionByName(root.select(rows.columns))
    nodes = _nodes(every)
    children = nodes.where("depth > 0").groupBy(*UP).agg(F.count(F.lit(1)).alias("n_children")).select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "n_children")
    counted = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = table(counted.withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    forget(nodes)
    below = _roll_up(counted).toDF(*KEY, "below", "saved_below")
    met = counted.join(below, KEY, "left")
    many = counted.where("n_ends > 1").select(*KEY, "n_ends")
    ends = join_counted(every.where("last").select(*KEY, "conv"), many, KEY, "n_ends", convs.count(), "inner").select(*KEY, "conv")
    met = met.join(_digests(_pieces(table(ends))), KEY, "left")
    parents = counted.where("n_children > 0").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of"))
    lower = join_counted(met.where("depth > 0"), parents, UP, "of", counted.count(), "inner").select(*_result(F.col("parent_conv_id")))
    top = met.where("depth = 0").select(*_result(F.lit(None).cast("bigint")))
    return top.unionByName(lower)


def _result(parent: Column) -> list[Column]:
    """The columns that come out, from those of a node and what is below it."""
    digest = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("ends"))
    return [
        F.col("conv_id"), F.col("depth"), parent.alias("parent_conv_id"), F.col("n_convs"), F.col("n_children"), (F.col("leaves") + F.coalesce("below", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"), digest.alias("ends_sha256"),
    ]
