"""Bars: one row for each symbol and time, in the shape every indicator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR = ("symbol", "time", "open", "high", "low", "close", "volume")
PRICES = BAR[2:]


def finite(column: Column | str) -> Column:
    """Numbers as doubles; what is not finite is missing."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def bars(df: DataFrame, symbol: str = "symbol", time: str = "time", **columns: str) -> DataFrame:
    """``df`` as bars: (symbol, time in UNIX seconds, open, high, low, close, volume).

    ``columns`` names the price columns where they differ; a missing volume column
    is all null. Symbols may be of any type; times must not repeat in a symbol.
    """
    picked = [F.col(symbol).alias("symbol"), F.col(time).cast("bigint").alias("time")]
    for name in PRICES:
        source = columns.get(name, name)
        there = source in df.columns
        if not there and name != "volume":
            raise ValueError(f"no column {source!r} for {name}")
        picked.append((finite(source) if there else F.lit(None).cast("double")).alias(name))
    return df.select(*picked)


def faulty_bars(df: DataFrame) -> DataFrame:
    """Symbols and times that are null or stand more than once; empty for good bars."""
    return df.groupBy("symbol", "time").count().where("count > 1 or time is null")
