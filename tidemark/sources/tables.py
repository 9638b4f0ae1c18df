"""Bars made from the tables at hand, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, symbol: str, ts: str, value: str, order: list[str], unit: str = "hour", volume: str | None = None) -> DataFrame:
    """Open, high, low and close of ``value`` per symbol and ``unit`` of time, in one aggregation with map-side combine.

    ``order`` tells which tick is first and last within the unit. Without
    ``volume`` ticks are counted. Null values do not count as ticks.
    """
    place = F.struct(*order)
    start = F.unix_timestamp(F.date_trunc(unit, F.col(ts).cast("timestamp")))
    size = F.count(value).cast("double") if volume is None else F.sum(volume).cast("double")
    return (
        ticks.where(F.col(value).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), start.cast("bigint").alias("time"))
        .agg(
            F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, place).alias("close"),
            size.alias("volume"),
        )
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values, a symbol for each type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tick_bars(events, "event_type", "ts", "value", ["ts", "event_id"])


EVENT_BARS_SQL = """
    SELECT event_type AS symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time,
           arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
           CAST(count(value) AS DOUBLE) AS volume
    FROM events WHERE value IS NOT NULL GROUP BY ALL
"""
