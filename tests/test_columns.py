"""Column helpers against plain Python over the last values of a series, with gaps and a flat stretch; and the public names."""

import importlib
import inspect
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tests.test_indicators import SCHEMA, smooth
from tidemark.functions import columns as c

N = 6


def fit(y):
    x = list(range(len(y)))
    mx, my = sum(x) / len(x), math.fsum(y) / len(y)
    tilt = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    return my - tilt * mx, tilt


def residual(y):
    base, tilt = fit(y)
    return sum((b - base - tilt * k) ** 2 for k, b in enumerate(y))


def r2(y):
    spread = sum((b - math.fsum(y) / len(y)) ** 2 for b in y)
    return 1 - residual(y) / spread if max(y) > min(y) else 0.0


def away(y):
    return math.fsum(abs(v - math.fsum(y) / len(y)) for v in y) / len(y)


#: Of the last N values, all there.
WHOLE = {
    "total": (c.total, math.fsum), "sma": (c.sma, lambda y: math.fsum(y) / N), "highest": (c.highest, max), "lowest": (c.lowest, min), "median": (c.median, statistics.median),
    "deviation": (c.deviation, statistics.pstdev), "mean_deviation": (c.mean_deviation, away), "wma": (c.wma, lambda y: sum(k * v for k, v in enumerate(y, 1)) / (N * (N + 1) / 2)),
    "slope": (c.slope, lambda y: fit(y)[1]), "endpoint": (c.endpoint, lambda y: fit(y)[0] + fit(y)[1] * (N - 1)), "forecast": (c.forecast, lambda y: fit(y)[0] + fit(y)[1] * N),
    "r_squared": (c.r_squared, r2), "standard_error": (c.standard_error, lambda y: math.sqrt(residual(y) / (N - 2))),
    "efficiency_ratio": (c.efficiency_ratio, lambda y: abs(y[-1] - y[0]) / p if (p := sum(abs(b - a) for a, b in zip(y, y[1:]))) else 0.0),
    "commodity_channel_index": (c.commodity_channel_index, lambda y: (y[-1] - math.fsum(y) / N) / (0.015 * away(y)) if away(y) else None),
}


@pytest.fixture(scope="module")
def rows():
    rows = [list(r) for r in smooth(50)]
    for k in (4, 20, 21):
        rows[k][5] = None
    for k in range(30, 40):
        rows[k][5] = 104.5
    return [tuple(r) for r in rows]


def test_windows_as_in_plain_python(spark, rows):
    w = c.over("symbol", "time")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = df.select("time", *[f("close", N, w).alias(name) for name, (f, _) in WHOLE.items()])
    assert str(made._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    found = {r.time: r for r in made.collect()}
    for i, r in enumerate(rows):
        last = [x[5] for x in rows[max(0, i - N + 1) : i + 1]]
        for name, (_, plain) in WHOLE.items():
            want = plain(last) if len(last) == N and None not in last else None
            got = found[r[1]][name]
            assert (got is None and want is None) or abs(got - want) < 1e-7, (name, i, got, want)


def test_values_of_earlier_bars_and_of_one_bar(spark, rows):
    w = c.over()
    df = spark.createDataFrame(rows, SCHEMA)
    made = df.select(
        "time", c.shifted("close", 2, w).alias("two"), c.before("close", w).alias("before"), c.partial_total("close", 3, w).alias("part"),
        c.true_range("high", "low", "close", w).alias("reach"), c.endpoint("close", 1, w).alias("own"), c.slope("close", 1, w).alias("none"),
    )
    found = {r.time: r for r in made.collect()}
    for i, r in enumerate(rows):
        got, closes = found[r[1]], [x[5] for x in rows]
        assert got.two == (closes[i - 2] if i >= 2 else None)
        assert got.before == next((x for x in closes[:i][::-1] if x is not None), None)
        there = [x for x in closes[max(0, i - 2) : i + 1] if x is not None]
        assert got.part == pytest.approx(math.fsum(there))
        last = closes[i - 1] if i else None
        assert got.reach == pytest.approx(max(r[3], r[3] if last is None else last) - min(r[4], r[4] if last is None else last))
        assert got.own == closes[i] and got.none is None


def test_numbers_at_the_floor(spark):
    values = [(0.0,), (4e-29,), (6e-29,), (2.4e-28,), (9e-28,), (1e-27,), (5.0,), (float("nan"),), (float("inf"),), (None,)]
    found = spark.createDataFrame(values, "x double").select("x", c.platform_decimal("x").alias("d"), c.is_zero("x", 1.0).alias("z"), c.known("x").alias("k")).collect()
    assert [r.d for r in found[:7]] == pytest.approx([0.0, 0.0, 1e-28, 2e-28, 9e-28, 1e-27, 5.0], rel=1e-9, abs=0)
    assert [r.z for r in found[:7]] == [True] * 6 + [False] and [r.k for r in found[6:]] == [5.0, None, None, None]
    with pytest.raises(ValueError):
        c.sma("x", 0, c.over())


#: Names that users of the library have, by module. A change here is a change for them.
PUBLIC = {
    "tidemark.catalog": "Definition Parameter catalog_df definition register unregister words",
    "tidemark.functions.kernels": "Aroon Directional Extreme Kernel Macd PartialSma Rsi Sma Smoothed TrueRange Window chained_ema divide ema expanding_wilder forming minus partial_ema wilder",
    "tidemark.model": "bars faulty_bars finite",
    "tidemark.plans.planner": "Request compute events fold_bars latest layers ordered points preview request",
    "tidemark.registry": "define register unregister",
    "tidemark.streaming.folds": "Series stream_folds",
    "tidemark.streaming.runtime": "Runtime patched reach",
    "tidemark.streaming.tables": "stream_bars stream_events",
}


@pytest.mark.parametrize("name", sorted(PUBLIC))
def test_public_names(name):
    module = importlib.import_module(name)
    own = {k for k, v in vars(module).items() if not k.startswith("_") and (inspect.isclass(v) or inspect.isfunction(v)) and v.__module__ == name}
    assert own == set(PUBLIC[name].split())


def test_public_columns():
    own = {k for k, v in vars(c).items() if not k.startswith("_") and inspect.isfunction(v) and v.__module__ == c.__name__}
    assert own == set(c.__all__)
