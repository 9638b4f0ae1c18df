import pytest

from tidemark.catalog import CATEGORIES, DEFINITIONS, catalog_df, definition
from tidemark.operators.recursive import RECURSIVE, RELOCATED
from tidemark.operators.windowed import WINDOWED
from tidemark.plans.queries import indicator_oracles, indicator_queries


def test_every_definition_is_implemented_once():
    kinds = [set(WINDOWED), set(RECURSIVE), set(RELOCATED)]
    assert len(DEFINITIONS) == 163 == sum(map(len, kinds))
    assert set.union(*kinds) == set(DEFINITIONS)
    assert {d.category for d in DEFINITIONS.values()} == set(CATEGORIES)


def test_every_indicator_has_a_query_and_sql():
    assert set(indicator_queries()) == {f"ind_{name}" for name in DEFINITIONS}
    assert set(indicator_oracles()) == {*indicator_queries(), "flagship"}


def test_names():
    assert definition("SMA").id == "SimpleMovingAverage"
    assert definition("obv").id == "BalanceVolume"
    assert definition("elderforceindex").id == "ElderForceIndex"
    with pytest.raises(KeyError):
        definition("no such thing")


@pytest.mark.parametrize("given", [{"length": 0}, {"length": 501}, {"length": 2.5}, {"length": float("nan")}, {"length": True}, {"other": 1}])
def test_refused_parameters(given):
    with pytest.raises(ValueError):
        definition("sma").resolve(given)


def test_parameters_by_alias_and_dynamic_outputs():
    d = definition("ichimoku")
    assert d.resolve({"tenkanPeriod": 5})["tenkanLength"] == 5
    assert d.resolve({"tenkanPeriod": 5, "tenkanLength": 7})["tenkanLength"] == 7
    ribbon = definition("maribbon")
    assert ribbon.outputs(ribbon.resolve({"ribbonCount": 3})) == ("ribbon0", "ribbon1", "ribbon2")
    with pytest.raises(ValueError):
        definition("fractals").resolve({"length": 4})


def test_catalog_table(spark):
    rows = {r.id: r for r in catalog_df(spark).collect()}
    assert len(rows) == 163 and rows["BollingerBands"].outputs == ["upper", "middle", "lower"]
    assert rows["RelativeStrengthIndex"].levels == [30.0, 70.0]
