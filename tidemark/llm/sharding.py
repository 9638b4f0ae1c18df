"""Proportional stratified interleaving, with DataFrame operations only.

Rows of a source are put in a seeded random order (by a digest of seed and id).
Row r of the n rows of its source gets the fraction (r - 1/2) / n; all rows are
sorted by fraction and cut into shards of equal count, so every shard holds each
source in the proportion it has in the whole table.

Neither ranking gathers a source, or the table, in one task. Both count rows of
buckets first (digest prefix within the source; equal steps of the fraction),
add up the counts of earlier buckets, and number rows within a bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, numbered

BUCKET_ROWS = 2000
SEED = "interleave-1"


def interleave(rows: DataFrame, shards: int, key: str = "id", source: str = "source", seed: str = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each).

    Counts of shards are at most one apart; a null source is a source of its own
    and a null key sorts as the word null. Rows that are equal in every column are
    told apart by nothing and may swap places. An empty table gives no rows. Columns
    ``shard`` and ``slot`` of ``rows`` are replaced; others keep their names and
    values, whatever they are called.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    inner = {c: f"c{i}" for i, c in enumerate(names)}  # no name of a column can meet one of those below
    rows = rows.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names])
    key, source = inner[key], inner[source]
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    ties = [F.col(c) for c in rows.columns if c != source]
    total = rows.count()
    buckets = buckets_for(total, BUCKET_ROWS, most=1 << 24)
    marked = cut(
        rows.withColumn("_digest", digest).withColumn(
            "_bucket", F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))
        )
    )
    ranked = numbered(marked, [source], "_bucket", [F.col("_digest"), *ties], "_rank").drop("_bucket")
    sizes = rows.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranked.join(sizes, F.col(source).eqNullSafe(F.col("_source"))).withColumn(
        "_fraction", (F.col("_rank") - 0.5) / F.col("_size")
    )
    placed = cut(placed.withColumn("_step", F.floor(F.col("_fraction") * buckets)).drop("_source"))
    order = [F.col("_fraction"), F.col(source).asc_nulls_first(), F.col("_digest"), *ties]
    sorted_rows = numbered(placed, [], "_step", order, "_place")
    shard = F.expr(f"cast((_place - 1) * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    out = sorted_rows.withColumn("shard", shard).withColumn("slot", F.col("_place") - 1 - start)
    return out.select(*[F.col(inner[c]).alias(c) for c in names], "shard", "slot")
