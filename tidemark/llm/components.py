"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def _min_neighbour(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("child", "parent").unionByName(
        edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    )
    least = _min_neighbour(both, "child", "parent")
    joined = both.join(least, both["child"] == least["_k"]).where(F.col("parent") > F.col("child"))
    return joined.select(F.col("parent").alias("child"), F.least("child", "_m").alias("parent"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _min_neighbour(edges, "child", "parent")
    joined = edges.join(least, edges["child"] == least["_k"])
    moved = joined.where(F.col("parent") != F.col("_m")).select(F.col("parent").alias("child"), F.col("_m").alias("parent"))
    return moved.unionByName(least.select(F.col("_k").alias("child"), F.col("_m").alias("parent")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots themselves.

    ``root`` is the smallest node that can be reached. Each round keeps at most
    as many edges as the last one, joins on nodes only after taking minima with
    map-side combine, and is written, so lineage stays short and a
    lost executor costs one round. Rounds grow with the logarithm of the longest
    chain. Self-links and null ends are ignored; no edges give no rows.
    """
    current = table(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .distinct()
    )
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return current.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        seen = mark
        before = current
        current = table(_small_star(_large_star(before).distinct()).distinct())
        forget(before)
