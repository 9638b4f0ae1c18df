"""All indicators at once: against SQL, on prefixes, on odd series and with gaps."""

import math
import re

import duckdb
import pytest

from tidemark.catalog import DEFINITIONS
from tidemark.model import BAR, bars, faulty_bars
from tidemark.operators.recursive import RECURSIVE, RELOCATED, Bar
from tidemark.plans.planner import compute, events, latest, points, request
from tidemark.plans.queries import indicator_oracles
from tidemark.sources.tables import event_bars

SCHEMA = "symbol string, time bigint, open double, high double, low double, close double, volume double"
COLUMNS = [n for n in DEFINITIONS if n not in RELOCATED]


def smooth(n=120, seed=0, symbol="a"):
    rows = []
    for i in range(n):
        c = 100 + 6 * math.sin((i + seed) / 5) + 2.5 * math.cos((i + seed) / 11) + 0.07 * i
        s = 0.6 + 0.9 * abs(math.sin((i + seed) / 3))
        rows.append((symbol, 1_700_000_000 + 60 * i, c - s / 3, c + s, c - s, c, 800.0 + (37 * i) % 400))
    return rows


def shapes():
    """Degenerate series: each close and spread by index."""
    made = {
        "constant": lambda i: (100, 0), "rising": lambda i: (100 + 0.5 * i, 0.5), "falling": lambda i: (200 - 0.5 * i, 0.5),
        "spike": lambda i: (300 if i == 40 else 100, 60 if i == 40 else 1), "alternating": lambda i: (100 + 5 * (i % 2), 1),
        "zero": lambda i: (0, 0), "plateau": lambda i: (100 + 2 * min(i, 29), 1 if i < 30 else 0), "ties": lambda i: ((105, 105, 103, 105)[i % 4], 0 if i % 4 == 3 else 2),
    }
    rows = []
    for name, f in made.items():
        before = None
        for i in range(90):
            c, s = map(float, f(i))
            o = c if before is None else before
            rows.append((name, 60 * i, o, max(o, c) + s, min(o, c) - s, c, 0.0 if name == "zero" else 1500.0))
            before = c
    return rows + [("tiny", 60 * i, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1500.0) for i in range(3)]


def everything(prefix=True):
    return [request(n, f"{n}_" if prefix else "") for n in COLUMNS]


def table(df):
    return {(r.symbol, r.time): r for r in df.collect()}


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    return con


def test_all_indicators_in_one_plan_agree_with_sql(spark, small, oracle):
    wanted = everything()
    got = table(compute(event_bars(spark, small), wanted))
    texts = indicator_oracles()
    for r in wanted:
        name = f"ind_{r.definition.id}"
        found = oracle.execute(texts[name])
        names = [d[0] for d in found.description]
        rows = found.fetchall()
        assert len(rows) == len(got)
        for row in rows:
            mine = got[row[0], row[1]]
            for column, value in zip(names[2:], row[2:]):
                x = mine[f"{r.definition.id}_{column}"]
                assert (x is None) == (value is None), (name, column, row)
                if x is not None:
                    assert abs(x - value) <= (1e-5 if "Kase" in name else 1e-6) * max(1, abs(value)), (name, column, row, x)


def test_prefix_of_a_series_gives_the_prefix_of_its_values(spark):
    wanted = everything()
    rows = smooth(150)
    whole = table(compute(spark.createDataFrame(rows, SCHEMA), wanted))
    part = table(compute(spark.createDataFrame(rows[:70], SCHEMA), wanted))
    for key, row in part.items():
        for c in row.asDict():
            x, y = row[c], whole[key][c]
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(x))), c


def test_odd_series_give_finite_numbers_or_nothing(spark):
    for row in compute(spark.createDataFrame(shapes(), SCHEMA), everything()).collect():
        for c, x in row.asDict().items():
            assert x is None or isinstance(x, (str, int)) or math.isfinite(x), (row.symbol, c, x)


def test_gaps_leave_other_symbols_alone_and_never_give_nan(spark):
    rows = smooth(90) + [tuple(None if (k > 1 and i in (2, 20, 40, 41)) else x for k, x in enumerate(r)) for i, r in enumerate(smooth(90, symbol="b"))]
    got = compute(spark.createDataFrame(rows, SCHEMA), everything()).collect()
    alone = table(compute(spark.createDataFrame(smooth(90), SCHEMA), everything()))
    for row in got:
        for c, x in row.asDict().items():
            assert x is None or isinstance(x, (str, int)) or math.isfinite(x)
        if row.symbol == "a":
            assert row == alone["a", row.time]


def test_empty_input(spark):
    assert compute(spark.createDataFrame([], SCHEMA), everything()).count() == 0
    assert events(spark.createDataFrame([], SCHEMA), request("zigzag")).count() == 0


def test_one_exchange_and_one_sort_for_many_windows(spark):
    wanted = [request("sma", "a_"), request("bb", "b_"), request("stochastic", "c_"), request("macd", "d_")]
    plan = compute(spark.createDataFrame(smooth(), SCHEMA), wanted).select("symbol", "d_macd")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Window") >= 1
    assert plan.count("Exchange hashpartitioning(symbol") == 1 == len(re.findall(r"Sort \[symbol", plan))


def test_turns_and_fractals(spark):
    rows = [("a", i, c, c + 1, c - 1, c, 1.0) for i, c in enumerate([10.0, 11.0, 12.0, 9.0, 8.0, 12.0, 13.0, 7.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = events(df, request("zigzag", deviation=0.1)).orderBy("source_index").collect()
    assert [r.value for r in found] == [12.0, 8.0, 13.0]
    assert latest(events(df, request("zigzag", deviation=0.1))).count() <= 3
    peaks = events(df, request("fractals", length=3)).where("output_id = 'up'").orderBy("source_index").collect()
    assert [(r.target_index, r.value) for r in peaks] == [(2, 13.0), (6, 14.0)]


def test_parabolic_stop_follows_a_rise_and_turns_on_a_fall(spark):
    closes = [10.0 + i for i in range(12)] + [21.0 - 2 * i for i in range(1, 9)]
    rows = [("a", i, c, c + 0.5, c - 0.5, c, 1.0) for i, c in enumerate(closes)]
    got = [r.value for r in compute(spark.createDataFrame(rows, SCHEMA), [request("psar")]).orderBy("time").collect()]
    assert got[0] is None and all(x is not None for x in got[1:])
    assert all(v < b[4] for v, b in zip(got[2:11], rows[2:11]))
    assert all(x <= y + 1e-12 for x, y in zip(got[2:10], got[3:11]))
    assert all(v > b[3] for v, b in zip(got[-4:], rows[-4:]))


def test_long_view_and_bad_requests(spark):
    df = spark.createDataFrame(smooth(40), SCHEMA)
    wanted = request("macdhistogram")
    assert {r.output_id for r in points(compute(df, [wanted]), wanted).collect()} == {"macd", "signal", "histogram"}
    with pytest.raises(ValueError):
        compute(df, [request("sma"), request("ema")])
    with pytest.raises(ValueError):
        compute(df, [request("zigzag")])


def test_bar_contract(spark):
    raw = spark.createDataFrame([("x", 1, 1.0, float("inf"), 1.0, float("nan")), ("x", 1, 1.0, 2.0, 1.0, 1.5)], "s string, t int, o double, h double, l double, c double")
    made = bars(raw, "s", "t", open="o", high="h", low="l", close="c")
    assert made.columns == list(BAR)
    first = made.collect()[0]
    assert first.high is None and first.close is None and first.volume is None
    assert faulty_bars(made).count() == 1
    with pytest.raises(ValueError):
        bars(raw, "s", "t")


@pytest.mark.parametrize("name", sorted(RECURSIVE))
def test_folds_can_be_carried_over(name):
    """A pickled fold goes on as the one it was made from."""
    import pickle

    rows = [Bar(i, *r[1:]) for i, r in enumerate(smooth(130))]
    fold = RECURSIVE[name](DEFINITIONS[name].resolve())
    for b in rows[:60]:
        fold.step(b)
    other = pickle.loads(pickle.dumps(fold))
    assert [fold.step(b) for b in rows[60:]] == [other.step(b) for b in rows[60:]]
