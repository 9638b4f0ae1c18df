"""Definitions of all indicators: parameters with bounds, outputs, names, and how they are drawn."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .catalog_table import TABLE

_MACD = {"shortMaLength": ("macdShortMaLength",), "longMaLength": ("macdLongMaLength",)}
_PPO = {"shortPeriod": ("ppoShortPeriod",), "longPeriod": ("ppoLongPeriod",)}
#: Parameters that stand for others; the own name wins, then the first one here.
PARAMETER_ALIASES = {
    "Acceleration": {"shortMaLength": ("aoShortMaLength",), "longMaLength": ("aoLongMaLength",)},
    "ElderImpulseSystem": _MACD,
    "GatorOscillator": {
        "jawLength": ("histogram1Line1Length",), "jawShift": ("histogram1Line1Shift",),
        "lipsLength": ("histogram1Line2Length", "histogram2Line1Length"), "lipsShift": ("histogram1Line2Shift", "histogram2Line1Shift"),
        "teethLength": ("histogram2Line2Length",), "teethShift": ("histogram2Line2Shift",),
    },
    "Ichimoku": {
        "tenkanLength": ("tenkanPeriod",), "kijunLength": ("kijunPeriod",), "senkouBLength": ("senkouBPeriod",), "chinkouLength": ("chikouLength",),
    },
    "MovingAverageConvergenceDivergenceHistogram": _MACD,
    "MovingAverageConvergenceDivergenceSignal": _MACD,
    "PercentagePriceOscillatorHistogram": _PPO,
    "PercentagePriceOscillatorSignal": _PPO,
    "SchaffTrendCycle": {"shortMaLength": ("macdMacdShortMaLength",), "longMaLength": ("macdMacdLongMaLength",), "signalMaLength": ("macdSignalMaLength",)},
    "WoodiesCCI": {"smaLength": ("sMALength", "smalength")},
}

CATEGORIES = ("Trend", "Momentum", "Volatility", "Volume", "Price", "SupportResistance", "MarketStrength", "Cycle", "Statistical")


def words(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)


@dataclass(frozen=True)
class Parameter:
    name: str
    default: float
    least: float
    most: float

    @property
    def whole(self) -> bool:
        return all(float(x).is_integer() for x in (self.default, self.least)) and re.search("length|period|shift$|count|lines", self.name.lower()) is not None

    def check(self, value: float) -> float:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise ValueError(f"{self.name} is not a finite number: {value!r}")
        if self.whole and not float(value).is_integer():
            raise ValueError(f"{self.name} is not a whole number: {value!r}")
        if not self.least <= value <= self.most:
            raise ValueError(f"{self.name} is not within {self.least:g} and {self.most:g}: {value!r}")
        return int(value) if self.whole else float(value)


@dataclass(frozen=True)
class Definition:
    id: str
    category: str
    aliases: tuple[str, ...]
    parameters: tuple[Parameter, ...]
    output_names: tuple[str, ...]
    pane: str
    measure: str
    painter: str
    scale: tuple[float, ...]
    levels: tuple[float, ...]

    @property
    def name(self) -> str:
        """The id as words."""
        return words(self.id)

    def resolve(self, given: dict[str, float] | None = None) -> dict[str, float]:
        """All parameters: given ones by name or alias, others at their default."""
        given = dict(given or {})
        aliases = PARAMETER_ALIASES.get(self.id, {})
        out = {}
        for p in self.parameters:
            names = [n for n in (p.name, *aliases.get(p.name, ())) if n in given]
            out[p.name] = p.check(given[names[0]]) if names else (int(p.default) if p.whole else p.default)
            for n in names:
                given.pop(n)
        if given:
            raise ValueError(f"{self.id} has no parameter {', '.join(sorted(given))}")
        if self.id == "Fractals" and out["length"] % 2 == 0:
            raise ValueError("length must be odd")
        return out

    def outputs(self, parameters: dict[str, float]) -> tuple[str, ...]:
        if self.id == "MovingAverageRibbon":
            return tuple(f"ribbon{k}" for k in range(int(parameters["ribbonCount"])))
        if self.id == "RainbowCharts":
            return tuple(f"sma{k}" for k in range(1, int(parameters["lines"])))
        return self.output_names


def _parse() -> dict[str, Definition]:
    found, category = {}, ""
    for line in TABLE.strip().splitlines():
        if line.startswith("["):
            category = line.strip("[]")
            continue
        cells = [c.strip() for c in line.split("|")]
        cells += [""] * (9 - len(cells))
        ident, aliases, parameters, outputs, pane, measure, painter, scale, levels = cells
        parsed = []
        for item in parameters.split():
            name, bounds = item.split("=")
            parsed.append(Parameter(name, *map(float, bounds.split(":"))))
        numbers = lambda text, by=None: tuple(float(x) for x in text.split(by)) if text else ()
        found[ident] = Definition(
            ident, category, tuple(aliases.split()), tuple(parsed), tuple(outputs.split()), pane, measure, painter, numbers(scale, ":"), numbers(levels)
        )
    return found


DEFINITIONS = _parse()


def register(added: Definition) -> None:
    """Add a definition; an id that is there already, in whatever case, is an error. See ``registry`` for what it computes."""
    if not re.fullmatch(r"[A-Za-z]\w*", added.id):
        raise ValueError(f"an id is a word: {added.id!r}")
    if added.id.lower() in {i.lower() for i in DEFINITIONS}:
        raise ValueError(f"there is an indicator {added.id!r} already")
    for p in added.parameters:
        p.check(p.default)
    DEFINITIONS[added.id] = added
    _by_name.cache_clear()


def unregister(name: str) -> None:
    """Take a definition away, by its id."""
    if name not in DEFINITIONS:
        raise KeyError(f"no indicator {name!r}")
    del DEFINITIONS[name]
    _by_name.cache_clear()


@lru_cache
def _by_name() -> dict[str, str]:
    names: dict[str, str] = {}
    for d in DEFINITIONS.values():
        for alias in d.aliases:
            names.setdefault(alias.lower(), d.id)
    return {**names, **{i.lower(): i for i in DEFINITIONS}}


def definition(name: str) -> Definition:
    """By id or alias, whatever the case; ids win, then the first indicator with the alias."""
    found = _by_name().get(name.strip().lower())
    if found is None:
        raise KeyError(f"no indicator {name!r}")
    return DEFINITIONS[found]


CATALOG_SCHEMA = (
    "id string, name string, full_name string, category string, group string, aliases array<string>, pane string, measure string, "
    "params array<struct<name: string, aliases: array<string>, default: double, least: double, most: double, step: double>>, outputs array<string>, "
    "painter string, scale struct<least: double, most: double>, levels array<double>"
)


def catalog_df(spark: SparkSession) -> DataFrame:
    rows = []
    for d in DEFINITIONS.values():
        others = PARAMETER_ALIASES.get(d.id, {})
        params = [(p.name, list(others.get(p.name, ())), float(p.default), float(p.least), float(p.most), 1.0 if p.whole else None) for p in d.parameters]
        rows.append((
            d.id, d.aliases[0] if d.aliases else d.id, d.name, d.category, words(d.category), list(d.aliases), d.pane, d.measure, params, list(d.outputs(d.resolve())), d.painter or None, d.scale or None, list(d.levels),
        ))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
