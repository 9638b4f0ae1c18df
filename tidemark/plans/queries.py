"""One query for each indicator, at its default parameters, over all event bars; and queries of what is built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import DEFINITIONS
from ..operators.recursive import RELOCATED
from ..operators.windowed import WINDOWED
from ..sources.tables import event_bars
from .fold_oracle import FOLDS, event_sql, fold_sql
from .oracle import BARS, DIGITS, rounded, windowed_sql
from .planner import Request, compute, events, preview, request
from .scan import LINEAR, long_series


#: Results whose exact value often lies half way between two of the usual digits, or that are large.
FINER = {"Envelope": 9, "VolumeWeightedMovingAverage": 9, "EaseOfMovement": 9, "KasePeakOscillator": 5}
#: Products of price ratios swing from 1e-20 to 1e270 on event values, beyond any fixed number of digits; they are compared as they are.
EXACT = ("McGinleyDynamic", "NegativeVolumeIndex", "PositiveVolumeIndex")
#: Chained means of prices in cents lie half way between decimals at any number of digits; these are compared in single precision.
SINGLE = ("MovingAverageRibbon",)


def _digits(name: str) -> int | str | None:
    return None if name in EXACT else "single" if name in SINGLE else FINER.get(name, DIGITS)


def _rounded(df: DataFrame, columns: list[str], digits: int | str | None = DIGITS) -> DataFrame:
    """Rounded outputs, without negative zeros."""

    def tidy(c: str) -> Column:
        r = F.col(c) if digits is None else F.col(c).cast("float").cast("double") if digits == "single" else F.round(c, digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)

    return df.select("symbol", "time", *[tidy(c) for c in columns])


def _line_query(wanted: Request) -> Callable[[SparkSession, str], DataFrame]:
    name = wanted.definition.id
    return lambda spark, sf_dir: _rounded(compute(event_bars(spark, sf_dir), [wanted]), wanted.columns, _digits(name))


def _event_query(wanted: Request) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = events(event_bars(spark, sf_dir), wanted)
        return found.select("symbol", "output_id", "source_index", "target_index", "report_index", F.round("value", DIGITS).alias("value"))

    return run


def _long_query(wanted: Request) -> Callable[[SparkSession, str], DataFrame]:
    """By stretches of a few weeks of hourly bars."""
    return lambda spark, sf_dir: _rounded(long_series(event_bars(spark, sf_dir), wanted, 3600 * 400), wanted.columns)


PREVIEWED = [
    request("Highest", "highest_", length=9), request("DonchianChannels", "donchian_", length=20), request("WilliamsR", "williams_", length=14),
    request("StochasticK", "stochastic_", length=14), request("Momentum", "momentum_", length=10), request("RateOfChange", "roc_", length=10),
    request("BollingerBands", "bands_", length=20), request("KaufmanEfficiencyRatio", "ratio_", length=10), request("SimpleMovingAverage", "sma_", length=20),
    request("ExponentialMovingAverage", "ema_", length=20),
]


def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the last bar of each symbol while it is still forming."""
    bars = event_bars(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max("time").alias("last"))
    dated = bars.join(last, "symbol")
    found = preview(dated.where("time < last").drop("last"), dated.where("time = last").drop("last"), PREVIEWED)
    return _rounded(found, [c for r in PREVIEWED for c in r.columns])


def _preview_sql() -> str:
    """The same by hand: k counts bars back from the one that is forming, which has 1."""
    def over(call: str, first: int, last: int) -> str:
        return f"{call} FILTER (WHERE k BETWEEN {first} AND {last})"

    def at(k: int) -> str:
        return f"max(close) FILTER (WHERE k = {k})"

    high, low = over("max(high)", 1, 15), over("min(low)", 1, 15)
    middle, width = over("avg(close)", 2, 21), over("stddev_pop(close)", 2, 21)
    values = {
        "highest_line": over("max(close)", 1, 10),
        "donchian_upper": over("max(high)", 1, 21), "donchian_middle": f"({over('max(high)', 2, 21)} + {over('min(low)', 2, 21)}) / 2", "donchian_lower": over("min(low)", 1, 21),
        "williams_line": f"-100 * ({high} - {at(1)}) / nullif({high} - {low}, 0)", "stochastic_line": f"coalesce(100 * ({at(1)} - {low}) / nullif({high} - {low}, 0), 0)",
        "momentum_line": f"{at(1)} - {at(12)}", "roc_line": f"100 * ({at(1)} - {at(12)}) / nullif({at(12)}, 0)",
        "bands_upper": f"{middle} + 2 * {width}", "bands_middle": over("avg(close)", 1, 20), "bands_lower": f"{middle} - 2 * {width}",
        "ratio_line": f"coalesce(abs({at(1)} - {at(11)}) / nullif({over('sum(move)', 1, 10)}, 0), 0)", "sma_line": over("avg(close)", 1, 20),
    }
    chosen = ", ".join(rounded(text, name, DIGITS) for name, text in values.items())
    ema = fold_sql(request("ExponentialMovingAverage", "ema_", length=20))
    return f"""
        WITH {BARS}, counted AS (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY time)) AS move FROM bars
        ), lines AS (SELECT symbol, max(time) AS time, {chosen} FROM counted GROUP BY symbol)
        SELECT lines.*, e.ema_line FROM lines JOIN ({ema}) e USING (symbol, time)
    """


def indicator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"ind_{name}": (_event_query if name in RELOCATED else _line_query)(request(name)) for name in DEFINITIONS}


def built_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries of what is built on the indicators: long series, and bars that are still forming."""
    return {f"long_{name}": _long_query(request(name)) for name in LINEAR} | {"preview_lines": preview_lines}


def built_oracles() -> dict[str, str]:
    return {f"long_{name}": fold_sql(request(name)) for name in LINEAR} | {"preview_lines": _preview_sql()}


def indicator_oracles() -> dict[str, str]:
    """SQL for each, and for the flagship query."""
    found = {}
    for name in DEFINITIONS:
        if name in WINDOWED:
            found[f"ind_{name}"] = windowed_sql(request(name), _digits(name))
        elif name in FOLDS:
            found[f"ind_{name}"] = fold_sql(request(name), _digits(name))
        elif name in RELOCATED:
            found[f"ind_{name}"] = event_sql(request(name))
    parts = [(windowed_sql if r.definition.id in WINDOWED else fold_sql)(r) for r in FLAGSHIP]
    joined = parts[0]
    for part in parts[1:]:
        joined = f"SELECT * FROM ({joined}) JOIN ({part}) USING (symbol, time)"
    found["flagship"] = joined
    return found


FLAGSHIP = [
    request("SimpleMovingAverage", "sma_", length=20), request("BollingerBands", "bb_", length=20),
    request("RelativeStrengthIndex", "rsi_", length=14), request("MovingAverageConvergenceDivergenceHistogram", "macd_"),
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, bands, strength and convergence of all event bars in one plan."""
    return _rounded(compute(event_bars(spark, sf_dir), FLAGSHIP), [c for r in FLAGSHIP for c in r.columns])
