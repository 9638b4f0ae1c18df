"""Smoothed means over cut series against the folds, with gaps, and that no task has a whole series."""

import math

import pytest
from pyspark.sql import functions as F

from tests.test_indicators import SCHEMA, smooth
from tidemark.plans import scan
from tidemark.plans.planner import compute, request
from tidemark.plans.queries import built_oracles, built_queries


def gappy(rows, at):
    return [(*r[:5], None, r[6]) if i in at else r for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def bars(spark):
    """Long and short series; gaps after the seed, in it, on the first bar, and everywhere."""
    rows = smooth(400, symbol="whole") + gappy(smooth(300, seed=3, symbol="late"), {150, 151, 240}) + gappy(smooth(120, seed=5, symbol="seed"), {2, 90}) + gappy(smooth(60, seed=6, symbol="first"), {0})
    rows += smooth(7, symbol="short") + gappy(smooth(30, symbol="none"), set(range(30)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(scan.LINEAR))
def test_as_the_folds_have_them(bars, name):
    wanted = request(name)
    want = {(r.symbol, r.time): r for r in compute(bars, [wanted]).collect()}
    found = scan.long_series(bars, wanted, stretch=60 * 33).collect()
    assert len(found) == len(want)
    for r in found:
        for c in wanted.columns:
            x, y = r[c], want[r.symbol, r.time][c]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (r.symbol, r.time, c, x, y)


def test_one_series_in_many_tasks(spark):
    """A stretch is a group of its own; of 2000 bars none has more than the bars of a stretch."""
    rows = smooth(2000, symbol="one")
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = request("ExponentialMovingAverage", length=40)
    assert 60 * 95 <= scan.stretch_for(df, 100) <= 60 * 105
    cut = scan.long_series(df, wanted, stretch=60 * 100)
    value, seen = None, []
    for i, r in enumerate(rows):
        seen.append(r[5])
        value = None if i < 39 else math.fsum(seen) / 40 if i == 39 else value + (r[5] - value) * 2 / 41
        rows[i] = r[1], value
    found = {r.time: r.line for r in cut.select("time", "line").collect()}
    assert all((found[t] is None) if v is None else math.isclose(found[t], v, rel_tol=1e-11) for t, v in rows)
    sizes = df.groupBy(F.floor(F.col("time") / 6000)).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 100 and sizes[1] >= 20


def test_odd_series(spark):
    with pytest.raises(ValueError):
        scan.long_series(spark.createDataFrame([], SCHEMA), request("Highest"), 60)
    assert scan.long_series(spark.createDataFrame([], SCHEMA), request("ExponentialMovingAverage")).count() == 0


def test_what_is_built_on_indicators_has_sql():
    assert set(built_queries()) == set(built_oracles()) == {"preview_lines", *(f"long_{name}" for name in scan.LINEAR)}
