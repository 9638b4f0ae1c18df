import pytest

from tests.test_indicators import SCHEMA, smooth
from tidemark.catalog import DEFINITIONS, Parameter, catalog_df, definition
from tidemark.functions.dialect import Formula
from tidemark.operators.recursive import Fold
from tidemark.plans.planner import compute, request
from tidemark.registry import define, register, unregister


def midpoint(q, p):
    return Formula({"line": f"(({q.high('close', p['length'])}) + ({q.low('close', p['length'])})) / 2"})


class Streak(Fold, base=True):
    """Closes that rose in a row."""

    def start(self):
        self.last, self.n = None, 0

    def step(self, b):
        self.n = self.n + 1 if self.last is not None and b.close is not None and b.close > self.last else 0
        self.last = b.close
        return (float(self.n),)


def test_own_indicators_join_others(spark):
    length = Parameter("length", 5, 1, 100)
    away = [register(define("CloseMidpoint", parameters=(length,), aliases=("mid",)), formula=midpoint), register(define("RisingStreak", ("n",)), fold=Streak)]
    try:
        rows = smooth(60)
        got = compute(spark.createDataFrame(rows, SCHEMA), [request("mid", "m_", length=7), request("risingstreak", "s_"), request("sma", "a_")]).orderBy("time").collect()
        closes = [r[5] for r in rows]
        assert got[5].m_line is None and all(g.m_line == (max(closes[i - 6 : i + 1]) + min(closes[i - 6 : i + 1])) / 2 for i, g in enumerate(got) if i >= 6)
        streak = 0
        for i, g in enumerate(got):
            streak = streak + 1 if i and closes[i] > closes[i - 1] else 0
            assert g.s_n == streak
        assert {r.id for r in catalog_df(spark).where("id in ('CloseMidpoint', 'RisingStreak')").collect()} == {"CloseMidpoint", "RisingStreak"}
        with pytest.raises(ValueError):
            register(define("closemidpoint", parameters=(length,)), formula=midpoint)
    finally:
        for f in away:
            f()
    assert len(DEFINITIONS) == 163
    with pytest.raises(KeyError):
        definition("mid")


@pytest.mark.parametrize("bad", [lambda: register(define("X")), lambda: register(define("X", ("other",), (Parameter("length", 5, 1, 9),)), formula=midpoint), lambda: register(define("no word!"), fold=Streak)])
def test_refused_registrations(bad):
    with pytest.raises(ValueError):
        bad()
    assert "X" not in DEFINITIONS
    with pytest.raises(KeyError):
        unregister("X")


@pytest.mark.parametrize(("name", "given", "parameter"), [
    ("gator", {"histogram2Line1Length": 9}, "lipsLength"), ("gator", {"histogram1Line2Length": 9, "histogram2Line1Length": 4}, "lipsLength"),
    ("macdsignal", {"macdShortMaLength": 9}, "shortMaLength"), ("macdhistogram", {"macdLongMaLength": 9}, "longMaLength"), ("pposignal", {"ppoShortPeriod": 9}, "shortPeriod"),
    ("ppohistogram", {"ppoLongPeriod": 9}, "longPeriod"), ("elderimpulse", {"macdShortMaLength": 9}, "shortMaLength"), ("wcci", {"smalength": 9}, "smaLength"),
])
def test_parameter_aliases(name, given, parameter):
    assert definition(name).resolve(given)[parameter] == 9
