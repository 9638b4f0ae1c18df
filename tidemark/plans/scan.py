"""Smoothed means of series that are too long for one task.

value += (x - value) * weight is affine in the value before, and affine steps compose:
a stretch of bars comes to one factor and one term, whatever it starts from. So a series
is cut into stretches of time. Each comes to its factor and term in a task of its own,
these are run through in order of time (a row for each stretch), and every stretch is
stepped through again from the value that reaches it. The mean of the first values, from
which a line starts, is a sum and goes the same way.

What a stretch needs to know of those before it is how many values they had: counts per
stretch with map-side combine. Means of means are another round. Bars of a stretch meet
in one task; ``stretch_for`` gives a length that holds about so many.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import BAR
from .planner import Request

BARS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Mean:
    """``out``: values of column ``x`` smoothed from the mean of the first ``n`` on.

    ``gap``: a missing value is passed over ("skip"), leaves no line at all if it is among
    the first n bars ("seed"), or none from it on ("all").
    """

    x: str
    n: int
    out: str
    weight: float
    gap: str = "skip"


def stretch_for(bars: DataFrame, rows: int = BARS_AT_ONCE) -> int:
    """Seconds that hold about ``rows`` bars of the longest series, were they spread evenly."""
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.max("time") - F.min("time") + 1).alias("span"))
    most = sizes.agg(F.max_by("span", "n"), F.max("n")).first()
    return 1 if most[1] is None else max(1, int(most[0] * rows / most[1]))


def _steps(x: np.ndarray, before: int, mean: Mean) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factor and term of each value there is, and its number in the series."""
    number = before + np.arange(len(x))
    seed = number < mean.n
    return np.where(seed, 1.0, 1 - mean.weight), np.where(seed, x / mean.n, x * mean.weight), number


def _there(rows: pa.Table, x: str) -> tuple[np.ndarray, np.ndarray]:
    column = rows[x].to_numpy()
    there = ~np.isnan(column.astype(float))
    return column[there].astype(float), there


def smooth(df: DataFrame, means: list[Mean], stretch: int) -> DataFrame:
    """``df`` (symbol, time, ..) with the columns of ``means``, all in one round."""
    inputs = sorted({m.x for m in means})
    cut = df.withColumn("_stretch", F.floor(F.col("time") / stretch))
    counts = cut.groupBy("symbol", "_stretch").agg(*[F.count(x).alias(f"_n_{x}") for x in inputs])
    earlier = W.partitionBy("symbol").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("symbol", "_stretch", *[F.coalesce(F.sum(f"_n_{x}").over(earlier), F.lit(0)).alias(f"_n_{x}") for x in inputs])
    rows = cut.join(starts.hint("merge"), ["symbol", "_stretch"])
    names = [*df.columns]
    each = ", ".join(f"a{k} double, b{k} double, gap{k} bigint, had{k} bigint" for k in range(len(means)))

    def compose(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("time")
        out = {"symbol": [key[0].as_py()], "_stretch": [key[1].as_py()]}
        for k, mean in enumerate(means):
            x, there = _there(part, mean.x)
            factor, term, number = _steps(x, part[f"_n_{mean.x}"][0].as_py(), mean)
            gap = int(np.argmin(there)) if not there.all() else None
            later = np.append(np.cumprod(factor[::-1])[::-1][1:], 1.0) if len(factor) else factor
            out |= {f"a{k}": [float(np.prod(factor))], f"b{k}": [float((term * later).sum())]}
            # The first gap of the stretch, and how many values of the series were before it.
            out |= {f"gap{k}": [None if gap is None else part["time"][gap].as_py()], f"had{k}": [None if gap is None else part[f"_n_{mean.x}"][0].as_py() + gap]}
        kinds = {"symbol": pa.string(), **{f"{c}{k}": pa.float64() for c in "ab" for k in range(len(means))}}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    def carry(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("_stretch")
        out = {"symbol": part["symbol"], "_stretch": part["_stretch"]}
        for k, mean in enumerate(means):
            value, end, reached, ends = 0.0, None, [], []
            for a, b, gap, had in zip(*(part[f"{c}{k}"].to_pylist() for c in ("a", "b", "gap", "had"))):
                reached.append(value)
                value = a * value + b
                if end is None and gap is not None and (mean.gap == "all" or (mean.gap == "seed" and had < mean.n)):
                    end = gap
                ends.append(end)
            out |= {f"_v{k}": pa.array(reached, pa.float64()), f"_end{k}": pa.array(ends, pa.int64())}
        return pa.table(out)

    def step(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("time")
        out = {c: part[c] for c in names}
        times = part["time"].to_numpy()
        for k, mean in enumerate(means):
            x, there = _there(part, mean.x)
            factor, term, number = _steps(x, part[f"_n_{mean.x}"][0].as_py(), mean)
            value, found = part[f"_v{k}"][0].as_py(), []
            for a, b in zip(factor.tolist(), term.tolist()):
                value = a * value + b
                found.append(value)
            line, shown = np.full(len(times), np.nan), np.zeros(len(times), bool)
            line[there], shown[there] = found, number >= mean.n - 1
            end = part[f"_end{k}"][0].as_py()  # where a gap ends the line
            shown &= times < end if end is not None else True
            out[mean.out] = pa.array(line, pa.float64(), mask=~shown)
        return pa.table(out)

    composed = rows.groupBy("symbol", "_stretch").applyInArrow(compose, f"symbol string, _stretch bigint, {each}")
    reached = composed.groupBy("symbol").applyInArrow(carry, "symbol string, _stretch bigint, " + ", ".join(f"_v{k} double, _end{k} bigint" for k in range(len(means))))
    ready = rows.join(reached.hint("merge"), ["symbol", "_stretch"])
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{m.out} double" for m in means)])
    return ready.groupBy("symbol", "_stretch").applyInArrow(step, shape)


Build = Callable[[DataFrame, dict, int], tuple[DataFrame, list[Column]]]
LINEAR: dict[str, Build] = {}


def _ema(x: str, n: int, out: str, gap: str = "skip") -> Mean:
    return Mean(x, n, out, 2 / (n + 1), gap)


def _single(weight: Callable[[int], float], gap: str) -> Build:
    def build(df: DataFrame, p: dict, stretch: int) -> tuple[DataFrame, list[Column]]:
        return smooth(df, [Mean("close", p["length"], "_m0", weight(p["length"]), gap)], stretch), [F.col("_m0")]

    return build


LINEAR["ExponentialMovingAverage"] = _single(lambda n: 2 / (n + 1), "seed")
LINEAR["SmoothedMovingAverage"] = LINEAR["WilderMovingAverage"] = _single(lambda n: 1 / n, "all")


def _cascade(shares: tuple[int, ...]) -> Build:
    def build(df: DataFrame, p: dict, stretch: int) -> tuple[DataFrame, list[Column]]:
        x, total = "close", F.lit(0.0)
        for k, share in enumerate(shares):
            df = smooth(df, [_ema(x, p["length"], f"_m{k}")], stretch)
            x, total = f"_m{k}", total + share * F.col(f"_m{k}")
        return df, [total]

    return build


LINEAR["DoubleExponentialMovingAverage"] = _cascade((2, -1))
LINEAR["TripleExponentialMovingAverage"] = _cascade((3, -3, 1))


def _guppy(df: DataFrame, p: dict, stretch: int) -> tuple[DataFrame, list[Column]]:
    sizes = (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)
    return smooth(df, [_ema("close", n, f"_m{n}", "seed") for n in sizes], stretch), [F.col(f"_m{n}") for n in sizes]


LINEAR["GuppyMultipleMovingAverage"] = _guppy


def _macd(names: tuple[str, ...]) -> Build:
    def build(df: DataFrame, p: dict, stretch: int) -> tuple[DataFrame, list[Column]]:
        lengths = [p[k] for k in p if "short" in k.lower()] + [p[k] for k in p if "long" in k.lower()]
        df = smooth(df, [_ema("close", n, f"_m{k}") for k, n in enumerate(lengths)], stretch).withColumn("_gap", F.col("_m0") - F.col("_m1"))
        signal = [p[k] for k in p if "signal" in k.lower()]
        if signal:
            df = smooth(df, [_ema("_gap", signal[0], "_signal")], stretch)
        lines = {"macd": F.col("_gap"), "signal": F.col("_signal"), "histogram": F.col("_gap") - F.col("_signal")}
        return df, [lines[n] for n in names]

    return build


LINEAR["MovingAverageConvergenceDivergence"] = _macd(("macd",))
LINEAR["MovingAverageConvergenceDivergenceSignal"] = _macd(("macd", "signal"))
LINEAR["MovingAverageConvergenceDivergenceHistogram"] = _macd(("macd", "signal", "histogram"))


def long_series(bars: DataFrame, wanted: Request, stretch: int | None = None) -> DataFrame:
    """(symbol, time, bar, outputs), as ``compute`` gives them, of an indicator of ``LINEAR`` over series of any length."""
    build = LINEAR.get(wanted.definition.id)
    if build is None:
        raise ValueError(f"{wanted.definition.id} is no composition of smoothed means: {', '.join(sorted(LINEAR))} are")
    df, values = build(bars.select(*BAR), wanted.resolved, stretch or stretch_for(bars))
    return df.select(*BAR, *[v.alias(c) for v, c in zip(values, wanted.columns)])
