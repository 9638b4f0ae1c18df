"""Exact top-k inner products with one KD-tree per shard.

Rows are dealt to shards of about ``SHARD_ROWS`` vectors. Each shard holds a tree
of median splits whose nodes carry tight bounding boxes. A query walks a tree best
first: a node's bound is the largest inner product any point of its box can have,
and the walk ends when the best bound left is under the kth score so far. Queries
first search one home shard; the kth score found there goes with them to all
others, where it prunes from the start. Queries travel in blocks, and a block
meets a shard's tree once. All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, cut

SHARD_ROWS = 4096
BLOCK_QUERIES = 256
LEAF = 128
LOWEST = -(1 << 63)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> dict:
    """Median splits on the widest side until ``leaf`` rows are left."""
    order = np.arange(len(ids))
    low, high, child, span = [], [], [], []

    def add(start: int, stop: int) -> int:
        rows = points[order[start:stop]]
        low.append(rows.min(axis=0))
        high.append(rows.max(axis=0))
        child.append((-1, -1))
        span.append((start, stop))
        return len(span) - 1

    todo = [add(0, len(ids))] if len(ids) else []
    while todo:
        node = todo.pop()
        start, stop = span[node]
        width = high[node] - low[node]
        if stop - start <= leaf or not width.any():
            continue
        middle = (start + stop) // 2
        axis = int(width.argmax())
        order[start:stop] = order[start:stop][np.argpartition(points[order[start:stop], axis], middle - start)]
        child[node] = (add(start, middle), add(middle, stop))
        todo.extend(child[node])
    return {"ids": ids[order], "points": points[order], "low": np.array(low), "high": np.array(high), "child": child, "span": span}


def search_tree(tree: dict, query: np.ndarray, own: int, k: int, kth: int = LOWEST) -> list[tuple[int, int]]:
    """Up to k (score, id) of rows other than ``own`` whose score is ``kth`` or more."""
    if not tree["span"]:
        return []
    bounds = np.maximum(query * tree["low"], query * tree["high"]).sum(axis=1).tolist()
    heap, best = [(-bounds[0], 0)], []
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < kth:
            break
        left, right = tree["child"][node]
        if left >= 0:
            for at in (left, right):
                if bounds[at] >= kth:
                    heapq.heappush(heap, (-bounds[at], at))
            continue
        start, stop = tree["span"][node]
        scores = tree["points"][start:stop] @ query
        hits = np.flatnonzero(scores >= kth)
        if len(hits) > k + 1:  # ties at the cut stay, as smaller ids win them
            floor = np.partition(scores[hits], len(hits) - k - 1)[len(hits) - k - 1]
            hits = hits[scores[hits] >= floor]
        for score, row in zip(scores[hits].tolist(), tree["ids"][start:stop][hits].tolist()):
            if row == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -row))
            elif (score, -row) > best[0]:
                heapq.heapreplace(best, (score, -row))
        if len(best) == k:
            kth = max(kth, best[0][0])
    return sorted(((s, -r) for s, r in best), key=lambda x: (-x[0], x[1]))


def _matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Rows of 64-bit integers; shorter vectors count as padded with zeros."""
    width = width or max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


def _pack_trees(key: tuple, table: pa.Table) -> pa.Table:
    tree = build_tree(table["id"].to_numpy(), _matrix(table["v"].to_pylist()))
    return pa.table({"shard": pa.array([key[0].as_py()]), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, queries in zip(batch.column(0), batch.column(1)):
                tree = pickle.loads(blob.as_py())
                width = tree["points"].shape[1]
                out = []
                for q in queries.as_py():
                    vector = _matrix([q["v"]], width)[0]
                    for score, row in search_tree(tree, vector, q["id"], k, q["kth"]):
                        out.append((q["id"], row, score))
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component; unusable vectors are left out."""
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(
        vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each query.

    Both inputs are (id, v) with integer components. A query's own id is no
    candidate. Ties go to the smaller id; fewer than k rows are all returned; rows
    that repeat an id count once each. Vectors of different lengths are compared
    as if padded with zeros; empty tables give no rows.
    """
    n, asked = vectors.count(), queries.count()
    shards, blocks = buckets_for(n, SHARD_ROWS), buckets_for(asked, BLOCK_QUERIES)
    index = cut(
        vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_pack_trees, "shard bigint, tree binary")
    )
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))

    def searched(waiting: DataFrame) -> DataFrame:
        packed = waiting.groupBy("shard", "block").agg(F.collect_list(F.struct("id", "v", "kth")).alias("asked"))
        return index.join(packed, "shard").select("tree", "asked").mapInArrow(
            _search(k), "query_id bigint, vec_id bigint, score bigint"
        )

    home = F.pmod(F.col("block"), F.lit(shards))
    first = cut(searched(dealt.select("id", "v", "block", home.alias("shard"), F.lit(LOWEST).alias("kth"))))
    known = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    carried = dealt.join(known, dealt["id"] == known["query_id"], "left").withColumn(
        "kth", F.when(F.col("n") >= k, F.col("least")).otherwise(LOWEST)
    )
    rest = carried.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    found = first.unionByName(searched(rest.select("id", "v", "block", F.col("shard").cast("bigint"), "kth")))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
