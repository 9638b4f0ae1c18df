"""One price, or an indicator's output, as the input of another indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prices of a bar by name.
FIELDS = {
    "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
    "hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "ohlc4": "(open + high + low + close) / 4",
}


def _lifted(df: DataFrame, value: Column) -> DataFrame:
    prices = [value.cast("double").alias(name) for name in ("open", "high", "low", "close")]
    return df.select("symbol", "time", *prices, F.lit(None).cast("double").alias("volume"))


def field(bars: DataFrame, name: str) -> DataFrame:
    """Bars whose four prices are one field; they have no volume."""
    if name not in FIELDS:
        raise ValueError(f"no field {name!r}; there are {', '.join(FIELDS)}")
    return _lifted(bars, F.expr(FIELDS[name]))


def output(computed: DataFrame, column: str) -> DataFrame:
    """Bars made of an output's values, where it has any; other bars are left out, not gaps."""
    if column not in computed.columns:
        raise ValueError(f"no output {column!r}")
    return _lifted(computed.where(F.col(column).isNotNull()), F.col(column))
