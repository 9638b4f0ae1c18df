"""SQL for recursive indicators on gap-free bars, written without their folds.

Smoothed means are sums over all earlier bars with the weights that the recursion
comes down to; what has no such form is a recursive query over the bar's index.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.dialect import DuckSql
from .oracle import BARS, DIGITS, rounded
from .planner import Request

Q = DuckSql()
TP, HL2 = "(high + low + close) / 3", "(high + low) / 2"
FOLDS: dict[str, Callable[["Query", dict], dict[str, str]]] = {}


class Query:
    """A chain of common table expressions; each has the columns of the one before and more."""

    def __init__(self, bars: str = BARS) -> None:
        self.parts, self.last = [bars.replace(" AS (", " AS MATERIALIZED (", 2)], "s0"

    def _add(self, text: str, *before: str) -> None:
        name = f"q{len(self.parts)}"
        self.parts += [*before, f"{name} AS MATERIALIZED ({text})"]
        self.last = name

    def cols(self, **texts: str) -> None:
        self._add(f"SELECT *, {', '.join(f'{t} AS {n}' for n, t in texts.items())} FROM {self.last}")

    def smooth(self, name: str, x: str, n: int, weight: float | None = None, warm: str = "none") -> None:
        """From the mean of the first n values of column x on, each value with its weight; before: nothing, the sum over n, or the mean."""
        a = 2 / (n + 1) if weight is None else weight
        keep = f"CAST({1 - a!r} AS DOUBLE)"
        share = f"CASE WHEN b.i < f.s_ + {n} THEN pow({keep}, greatest(a.i - f.s_ - {n - 1}, 0)) / {n} ELSE {a!r} * pow({keep}, a.i - b.i) END"
        early = {"none": "NULL", "part": "v_", "mean": f"v_ * {n} / (a.i - s_ + 1)"}[warm]
        old = self.last
        sums = (
            f"w_{name} AS MATERIALIZED (SELECT a.symbol, a.i, any_value(f.s_) AS s_, sum(b.{x} * {share}) AS v_ FROM {old} a "
            f"JOIN (SELECT symbol, min(i) AS s_ FROM {old} WHERE {x} IS NOT NULL GROUP BY symbol) f USING (symbol) "
            f"JOIN {old} b ON b.symbol = a.symbol AND b.i <= a.i AND b.i >= f.s_ GROUP BY a.symbol, a.i)"
        )
        self._add(
            f"SELECT a.*, CASE WHEN a.{x} IS NULL THEN NULL WHEN a.i - s_ + 1 < {n} THEN {early} ELSE v_ END AS {name} "
            f"FROM {old} a LEFT JOIN w_{name} w USING (symbol, i)",
            sums,
        )

    def fold(self, states: dict[str, tuple[str, str]]) -> None:
        """Columns by recursion: (on the first bar, from p on bar b)."""
        old, name = self.last, f"r{len(self.parts)}"
        first = ", ".join(f"{a} AS {s}" for s, (a, _) in states.items())
        later = ", ".join(b for _, b in states.values())
        table = (
            f"{name} AS (SELECT symbol, i, {first} FROM {old} b WHERE i = 0 UNION ALL "
            f"SELECT b.symbol, b.i, {later} FROM {name} p JOIN {old} b ON b.symbol = p.symbol AND b.i = p.i + 1)"
        )
        self._add(f"SELECT a.*, {', '.join('r.' + s for s in states)} FROM {old} a JOIN {name} r USING (symbol, i)", table)


def oracle(name: str):
    def keep(build):
        FOLDS[name] = build
        return build

    return keep


def fold_sql(wanted: Request, digits: int | str | None = DIGITS) -> str:
    q = Query()
    outputs = FOLDS[wanted.definition.id](q, wanted.resolved)
    chosen = ", ".join(rounded(t, wanted.prefix + n, digits) for n, t in outputs.items())
    return f"WITH RECURSIVE {', '.join(q.parts)} SELECT symbol, time, {chosen} FROM {q.last}"


def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _reach(q: Query) -> None:
    q.cols(c1=Q.lag("close"), h1=Q.lag("high"), l1=Q.lag("low"))
    q.cols(tr="CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END")


def _single(weight: Callable[[int], float] | None = None):
    def build(q: Query, p: dict) -> dict[str, str]:
        q.smooth("v", "close", p["length"], weight(p["length"]) if weight else None)
        return {"line": "v"}

    return build


FOLDS["ExponentialMovingAverage"] = _single()
FOLDS["SmoothedMovingAverage"] = FOLDS["WilderMovingAverage"] = _single(lambda n: 1 / n)


@oracle("DoubleExponentialMovingAverage")
def _(q, p):
    q.smooth("a", "close", p["length"])
    q.smooth("b", "a", p["length"])
    return {"line": "2 * a - b"}


@oracle("TripleExponentialMovingAverage")
def _(q, p):
    q.smooth("a", "close", p["length"])
    q.smooth("b", "a", p["length"])
    q.smooth("c", "b", p["length"])
    return {"line": "3 * a - 3 * b + c"}


@oracle("GuppyMultipleMovingAverage")
def _(q, p):
    out = {}
    for n in (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60):
        out[f"{'short' if n < 20 else 'long'}{n}"] = f"g{n}"
        q.smooth(f"g{n}", "close", n)
    return out


@oracle("T3MovingAverage")
def _(q, p):
    x, n, v = "close", p["length"], p["volumeFactor"]
    for k in range(1, 7):
        q.smooth(f"e{k}", x, n, warm="part")
        x = f"e{k}"
    c = (-(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2)
    return {"line": f"CASE WHEN i >= {n + 8} THEN {number(c[0])} * e6 + {number(c[1])} * e5 + {number(c[2])} * e4 + {number(c[3])} * e3 END"}


def _directional(q: Query, n: int) -> None:
    _reach(q)
    q.cols(up="high - h1", dn="l1 - low")
    q.cols(
        pd="CASE WHEN up IS NULL THEN NULL WHEN up > dn AND up > 0 THEN up ELSE 0 END",
        md="CASE WHEN dn IS NULL THEN NULL WHEN dn > up AND dn > 0 THEN dn ELSE 0 END",
    )
    for a, b in (("sp", "pd"), ("sm", "md"), ("st", "tr")):
        q.smooth(a, b, n, 1 / n, "mean")
    q.cols(pdi="coalesce(100 * sp / nullif(st, 0), 0)", mdi="coalesce(100 * sm / nullif(st, 0), 0)")
    q.cols(dxv=f"CASE WHEN i >= {n + 1} THEN coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) END")


@oracle("DirectionalIndex")
def _(q, p):
    _directional(q, p["length"])
    return {"plusDI": "CASE WHEN dxv IS NOT NULL THEN pdi END", "minusDI": "CASE WHEN dxv IS NOT NULL THEN mdi END", "dx": "dxv"}


@oracle("AverageDirectionalIndex")
def _(q, p):
    n = p["length"]
    _directional(q, n)
    q.smooth("m", "dxv", n, 1 / n, "mean")
    return {"dx": "dxv", "adx": f"CASE WHEN i >= {2 * n} THEN m END"}


@oracle("AdaptiveLaguerreFilter")
def _(q, p):
    g, h = number(p["gamma"]), number(1 - p["gamma"])
    l0, l1, l2, l3 = f"{h} * b.close + {g} * p.l0", "", "", ""
    l1 = f"{h} * ({l0}) + {g} * p.l1"
    l2 = f"{h} * ({l1}) + {g} * p.l2"
    l3 = f"{h} * ({l2}) + {g} * p.l3"
    z = lambda k: " * ".join([h] * k) + " * b.close"
    q.fold({"l0": (z(1), l0), "l1": (z(2), l1), "l2": (z(3), l2), "l3": (z(4), l3)})
    q.cols(v="(l0 + 2 * l1 + 2 * l2 + l3) / 6")
    return {"line": f"CASE WHEN max(CASE WHEN v >= close THEN 1 ELSE 0 END) {Q.so_far} = 1 THEN v END"}


@oracle("JurikMovingAverage")
def _(q, p):
    n, s = p["length"], 0.45 * (p["length"] - 1)
    beta, tilt = number(s / (s + 2)), number(p["phase"] / 100 + 1.5)
    a = f"CASE WHEN b.i < {n} THEN b.close ELSE p.a + {beta} * (b.close - p.a) END"
    m = f"CASE WHEN b.i < {n} THEN b.close ELSE p.m + {beta} * (({a}) - p.m) END"
    q.fold({"a": ("b.close", a), "m": ("b.close", m)})
    q.cols(before=Q.lag("m"))
    return {"line": f"CASE WHEN i = {n - 1} THEN close WHEN i >= {n} THEN m + {tilt} * (m - before) END"}


@oracle("KalmanFilter")
def _(q, p):
    prior = f"(p.e + {number(p['processNoise'])})"
    gain = f"({prior} / ({prior} + {number(p['measurementNoise'])}))"
    q.fold({"x": ("b.close", f"p.x + {gain} * (b.close - p.x)"), "e": (number(1), f"(1 - {gain}) * {prior}")})
    return {"line": f"CASE WHEN i >= {p['length'] - 1} THEN x END"}


@oracle("KaufmanAdaptiveMovingAverage")
def _(q, p):
    n, f, s = p["length"], 2 / (p["fastSCPeriod"] + 1), 2 / (p["slowSCPeriod"] + 1)
    q.cols(mv=f"abs(close - {Q.lag('close')})", gap=f"abs(close - {Q.lag('close', n)})")
    q.cols(er=f"coalesce(gap / nullif(sum(mv) {Q.over(n)}, 0), 0)")
    q.cols(sc=f"pow(er * {number(f - s)} + {number(s)}, 2)")
    q.fold({"v": ("b.close", f"CASE WHEN b.i <= {n} THEN b.close ELSE p.v + (b.close - p.v) * b.sc END")})
    return {"line": f"CASE WHEN i >= {n} THEN v END"}


@oracle("FractalAdaptiveMovingAverage")
def _(q, p):
    n, k = p["length"], p["length"] // 3
    span = lambda a, b: f"OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
    reach = lambda a, b: f"(max(close) {span(a, b)} - min(close) {span(a, b)}) / {k}"
    q.cols(ra=reach(n - 1, n - k), rb=reach(n - k - 1, n - 2 * k), rc=reach(n - 2 * k - 1, 0))
    q.cols(d="CASE WHEN rc > 0 AND ra + rb > 0 THEN greatest(1.0, least(2.0, (ln(ra + rb) - ln(rc)) / ln(2.0))) WHEN ra + rb > 0 THEN 2.0 ELSE 1.0 END")
    q.cols(al="exp(-4.6 * (d - 1))")
    q.fold({"v": ("b.close", f"CASE WHEN b.i <= {n - 1} THEN b.close ELSE p.v + b.al * (b.close - p.v) END")})
    return {"line": f"CASE WHEN i >= {n - 1} THEN v END"}


@oracle("OptimalTracking")
def _(q, p):
    n, w = p["length"], math.exp(-0.25)
    k, keep = number(1 - w), number(w)
    q.cols(a=HL2, r="(high - low) / 2", before=Q.lag(HL2))
    dr = f"CASE WHEN b.i < {n - 1} THEN 0 ELSE {k} * (b.a - b.before) + {keep} * p.dr END"
    rg = f"CASE WHEN b.i < {n - 1} THEN b.r ELSE {k} * b.r + {keep} * p.rg END"
    q.fold({"dr": (number(0), dr), "rg": ("b.r", rg)})
    q.cols(lm=f"CASE WHEN i >= {n - 1} AND rg <> 0 THEN abs(dr / rg) END")
    q.cols(lf=f"coalesce(last_value(lm IGNORE NULLS) {Q.so_far}, 0)")
    q.cols(al="(sqrt(pow(lf, 4) + 16 * lf * lf) - lf * lf) / 8")
    q.fold({"v": ("b.a", f"CASE WHEN b.i < {n - 1} THEN b.a ELSE b.al * b.a + (1 - b.al) * p.v END")})
    return {"line": f"CASE WHEN i >= {n - 1} THEN v END"}


@oracle("VariableMovingAverage")
def _(q, p):
    n = p["length"]
    q.cols(sd=f"CASE WHEN i >= {n} THEN ({Q.deviation('close', n)}) END")
    # The ring of prices takes the first bar and then bars from the first line on.
    q.cols(ring=f"CASE WHEN i = 0 OR i >= {n} THEN close END", nth=f"CASE WHEN i = 0 THEN 0 WHEN i >= {n} THEN i - {n - 1} END")
    old = q.last
    q._add(
        f"SELECT a.*, m.ap FROM {old} a LEFT JOIN (SELECT a.symbol, a.i, avg(b.ring) AS ap FROM {old} a JOIN {old} b ON a.symbol = b.symbol "
        f"AND b.nth < a.nth AND b.nth >= a.nth - {n} GROUP BY a.symbol, a.i) m USING (symbol, i)"
    )
    q.cols(al=f"2 / ({n} * (1 + {number(p['volatilityIndex'])} * coalesce(abs(sd / nullif(ap, 0)), 0)) + 1)")
    first = f"first_value(close) {Q.so_far}"
    q.cols(c0=first)
    q.fold({"v": ("b.close", f"CASE WHEN b.i < {n} THEN b.c0 ELSE p.v + (b.close - p.v) * b.al END")})
    return {"line": f"CASE WHEN i >= {n} THEN v END"}


@oracle("Vidya")
def _(q, p):
    n = p["length"]
    q.cols(d=f"close - {Q.lag('close')}")
    q.cols(cmo=f"coalesce(abs(sum(d) {Q.over(n)} / nullif(sum(abs(d)) {Q.over(n)}, 0)), 0)", seed=f"avg(close) {Q.over(n)}")
    q.fold({"v": ("b.close", f"CASE WHEN b.i <= {2 * n - 1} THEN b.seed ELSE p.v + (b.close - p.v) * b.cmo * {number(2 / (n + 1))} END")})
    return {"line": f"CASE WHEN i >= {2 * n - 1} THEN v END"}


@oracle("ZeroLagExponentialMovingAverage")
def _(q, p):
    n = p["length"]
    a = number(2 / (n + 1))
    q.cols(e=Q.lag("close", n - 1 - (n - 1) // 2))
    nxt = f"CASE WHEN b.i < {n - 1} THEN 0 ELSE {a} * (2 * b.close - b.e) + (1 - {a}) * p.v END"
    q.fold({"v": (number(0) if n > 1 else f"{a} * b.close", nxt)})
    return {"line": f"CASE WHEN i >= {n - 1} THEN v END"}


@oracle("SuperTrend")
def _(q, p):
    n, k = p["length"], number(p["multiplier"])
    _reach(q)
    q.smooth("atr", "tr", n, 1 / n, "mean")
    q.cols(bu=f"{HL2} + {k} * atr", bl=f"{HL2} - {k} * atr", mid=HL2)
    start = f"b.i <= {n - 1}"
    up = f"CASE WHEN {start} OR b.bu < p.up OR b.c1 > p.up THEN b.bu ELSE p.up END"
    lo = f"CASE WHEN {start} OR b.bl > p.lo OR b.c1 < p.lo THEN b.bl ELSE p.lo END"
    t0 = "CASE WHEN b.close >= b.mid THEN 1 ELSE -1 END"
    t = f"CASE WHEN {start} THEN {t0} WHEN p.t > 0 AND b.close <= ({lo}) THEN -1 WHEN p.t < 0 AND b.close >= ({up}) THEN 1 ELSE p.t END"
    q.fold({"up": ("b.bu", up), "lo": ("b.bl", lo), "t": (t0, t)})
    return {"value": f"CASE WHEN i >= {n - 1} THEN CASE WHEN t > 0 THEN lo ELSE up END END"}


def _aroon(q: Query, n: int) -> None:
    gone = f"OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    q.cols(wh=f"list(high) {gone}", wl=f"list(low) {gone}")
    states = {}
    for x, w, best, pick, up in (("high", "wh", "mx", "list_max", ">"), ("low", "wl", "mn", "list_min", "<")):
        ext = f"CASE WHEN b.{x} {up}= p.{best} THEN b.{x} ELSE p.{best} END"
        age = f"CASE WHEN b.{x} {up}= p.{best} THEN 0 ELSE p.{best}a + 1 END"
        rest = f"b.{w}[2:]"
        leaves = f"b.i >= {n} AND b.{w}[1] = ({ext})"
        better = f"{pick}({rest}) {up} b.{x}"
        states[best] = (f"b.{x}", f"CASE WHEN {leaves} THEN CASE WHEN {better} THEN {pick}({rest}) ELSE b.{x} END ELSE {ext} END")
        states[f"{best}a"] = (
            "CAST(0 AS BIGINT)", f"CASE WHEN {leaves} THEN CASE WHEN {better} THEN list_position({rest}, {pick}({rest})) ELSE 0 END ELSE {age} END"
        )
    q.fold(states)
    q.cols(au=f"CASE WHEN i >= {n - 1} THEN 100.0 * ({n} - mxa) / {n} END", ad=f"CASE WHEN i >= {n - 1} THEN 100.0 * ({n} - mna) / {n} END")


@oracle("Aroon")
def _(q, p):
    _aroon(q, p["length"])
    return {"up": "au", "down": "ad"}


@oracle("AroonOscillator")
def _(q, p):
    _aroon(q, p["length"])
    return {"line": "au - ad"}


@oracle("NickRypockTrailingReverse")
def _(q, p):
    n, s = p["length"], number(max(1, p["multiple"]) / 1000)
    k = f"((p.k + (b.close - p.k) / {n}) * {s})"
    a_hi = "greatest(p.hi, b.close)"
    falls = f"(p.t >= 0 AND b.close <= {a_hi} - {k})"
    lo1 = f"CASE WHEN {falls} THEN b.close ELSE p.lo END"
    b_lo = f"least({lo1}, b.close)"
    rises = f"(p.t <= 0 AND b.close >= {b_lo} + {k})"
    hi1 = f"CASE WHEN p.t >= 0 THEN {a_hi} ELSE p.hi END"
    k0 = f"(b.close * {s})"
    first_low = f"b.close >= b.close + {k0}"
    q.fold({
        "k": (k0, k),
        "hi": ("b.close", f"CASE WHEN {rises} THEN b.close ELSE {hi1} END"),
        "lo": ("b.close", f"CASE WHEN p.t <= 0 THEN {b_lo} ELSE {lo1} END"),
        "v": (
            f"CASE WHEN {first_low} THEN b.close - {k0} ELSE b.close + {k0} END",
            f"CASE WHEN p.t <= 0 THEN CASE WHEN {rises} THEN b.close - {k} ELSE {b_lo} + {k} END "
            f"WHEN {falls} THEN b.close + {k} ELSE {a_hi} - {k} END",
        ),
        "t": (f"CASE WHEN {first_low} THEN 1 ELSE -1 END", f"CASE WHEN p.t <= 0 THEN CASE WHEN {rises} THEN 1 ELSE -1 END WHEN {falls} THEN -1 ELSE 1 END"),
    })
    return {"line": f"CASE WHEN i >= {n - 1} THEN v END"}


def _alligator(q: Query, p: dict) -> None:
    q.cols(m=HL2)
    for x in ("jaw", "teeth", "lips"):
        n = p[f"{x}Length"]
        q.smooth(f"{x}0", "m", n, 1 / n)
    q.cols(**{x: Q.lag(f"{x}0", p[f"{x}Shift"]) for x in ("jaw", "teeth", "lips")})


@oracle("Alligator")
def _(q, p):
    _alligator(q, p)
    return {x: x for x in ("jaw", "teeth", "lips")}


@oracle("GatorOscillator")
def _(q, p):
    _alligator(q, p)
    return {"upper": "abs(jaw - lips)", "lower": "-abs(lips - teeth)"}


def _rsi(q: Query, name: str, x: str, n: int, array: bool = False) -> None:
    """Unchanged values repeat the last result."""
    q.cols(**{f"{name}d": f"{x} - {Q.lag(x)}"})
    q.cols(**{f"{name}u": f"greatest({name}d, 0)", f"{name}w": f"greatest(-{name}d, 0)"})
    q.cols(**{f"{name}g0": f"CASE WHEN {name}d IS NOT NULL THEN {name}u END", f"{name}l0": f"CASE WHEN {name}d IS NOT NULL THEN {name}w END"})
    q.smooth(f"{name}g", f"{name}g0", n, 1 / n, "part" if array else "none")
    q.smooth(f"{name}l", f"{name}l0", n, 1 / n, "part" if array else "none")
    total = f"({name}g + {name}l)"
    q.cols(**{f"{name}b": f"CASE WHEN {total} <> 0 AND {name}d <> 0 THEN 100 * {name}g / {total} END"})
    held = f"last_value({name}b IGNORE NULLS) {Q.so_far}"
    q.cols(**{name: f"CASE WHEN {total} IS NOT NULL THEN coalesce({held}, CASE WHEN {total} = 0 THEN 50 ELSE 100 * {name}g / {total} END) END"})


@oracle("RelativeStrengthIndex")
def _(q, p):
    _rsi(q, "r", "close", p["length"])
    return {"oscillator": "r"}


@oracle("DynamicZonesRSI")
def _(q, p):
    n = p["length"]
    _rsi(q, "r", "close", n)
    q.cols(hi=Q.high("r", n), lo=Q.low("r", n))
    q.cols(a=f"lo + (hi - lo) * {number(p['oversoldLevel'] / 100)}", z=f"lo + (hi - lo) * {number(p['overboughtLevel'] / 100)}")
    return {"line": "CASE WHEN hi IS NULL THEN NULL WHEN r <= a THEN 0 WHEN r >= z THEN 100 ELSE 100 * (r - a) / (z - a) END"}


@oracle("CompositeMomentum")
def _(q, p):
    _rsi(q, "r", "close", p["rsiLength"])
    q.smooth("f", "close", p["emaFastLength"])
    q.smooth("s", "close", p["emaSlowLength"])
    q.cols(b1=Q.lag("close", p["shortRocLength"]), b2=Q.lag("close", p["longRocLength"]))
    q.cols(v="100 * ((close - b1) / nullif(b1, 0) + (close - b2) / nullif(b2, 0) + (r - 50) / 50 + coalesce((f - s) / nullif(s, 0), 0)) / 4")
    q.cols(v2="CASE WHEN s IS NOT NULL AND f IS NOT NULL THEN v END")
    return {"composite": "v2", "sma": Q.mean("v2", p["smaLength"])}


@oracle("ConnorsRSI")
def _(q, p):
    n = p["rocRSIPeriod"]
    side = "sign(b.close - b.c1)"
    q.cols(c1=Q.lag("close"))
    q.fold({"st": (number(1), f"CAST(CASE WHEN {side} * p.st > 0 THEN p.st + {side} ELSE {side} END AS DOUBLE)")})
    q.cols(base=f"CASE WHEN i = 0 THEN close WHEN i <= {n} THEN first_value(close) {Q.so_far} ELSE {Q.lag('close', n)} END")
    q.cols(roc="100 * (close - base) / nullif(base, 0)")
    _rsi(q, "ra", "close", p["rsiPeriod"], array=True)
    _rsi(q, "rb", "st", p["streakRSIPeriod"], array=True)
    _rsi(q, "rc", "roc", n, array=True)
    at = f"i >= {max(p['rsiPeriod'], p['streakRSIPeriod'], n)}"
    return {k: f"CASE WHEN {at} THEN {v} END" for k, v in {"rsi": "ra", "updown": "rb", "rocrsi": "rc", "crsi": "(ra + rb + rc) / 3"}.items()}


@oracle("ConstanceBrownCompositeIndex")
def _(q, p):
    _rsi(q, "ra", "close", p["rsiLength"], array=True)
    _rsi(q, "rb", "close", p["shortRsiLength"], array=True)
    m, first = p["momentumLength"], max(p["rsiLength"], p["shortRsiLength"], p["rocLength"] + 1, p["momentumLength"])
    q.cols(mom=f"sum(rb) {Q.over(m)} / {m}", roc=f"ra - {Q.lag('ra', p['rocLength'])}")
    q.cols(v=f"CASE WHEN i >= {first} THEN coalesce(roc, 0) + coalesce(mom, 0) END")
    return {"composite": "v", "fastSma": Q.mean("v", p["fastSmaLength"]), "slowSma": Q.mean("v", p["slowSmaLength"])}


@oracle("ElderImpulseSystem")
def _(q, p):
    q.smooth("e", "close", p["emaLength"])
    q.smooth("f", "close", p["shortMaLength"])
    q.smooth("s", "close", p["longMaLength"])
    q.cols(m="f - s")
    q.cols(de=f"e - {Q.lag('e')}", dm=f"m - {Q.lag('m')}")
    return {"impulse": "CASE WHEN de IS NULL OR dm IS NULL THEN NULL WHEN de > 1e-9 AND dm > 1e-9 THEN 1 WHEN de < -1e-9 AND dm < -1e-9 THEN -1 ELSE 0 END"}


@oracle("KasePeakOscillator")
def _(q, p):
    _reach(q)
    q.smooth("atr", "tr", 10, 0.1, "mean")
    has = "i >= 10"
    q.cols(
        pk=f"CASE WHEN i < 9 THEN NULL WHEN {has} AND close > c1 THEN greatest(high, c1 + atr) WHEN {has} AND close < c1 THEN least(high, c1 + atr / 2) ELSE high END",
        vl=f"CASE WHEN i < 9 THEN NULL WHEN {has} AND close > c1 THEN greatest(low, c1 - atr / 2) WHEN {has} AND close < c1 THEN least(low, c1 - atr) ELSE low END",
    )
    q.cols(mp=f"max(pk) {Q.over(2)}", mv=f"min(vl) {Q.over(2)}", op=f"coalesce({Q.lag('pk')}, pk)", ov=f"coalesce({Q.lag('vl')}, vl)")
    a, b = 8 + p["shortPeriod"], 8 + p["longPeriod"]
    return {
        "shortTerm": f"CASE WHEN i >= {a} THEN coalesce(100 * (close - mv) / nullif(mp - mv, 0), 0) END",
        "longTerm": f"CASE WHEN i >= {b} THEN coalesce(100 * (close - ov) / nullif(op - ov, 0), 0) END",
    }


@oracle("LaguerreRSI")
def _(q, p):
    g, h = number(p["gamma"]), number(1 - p["gamma"])
    prev = {k: f"p.l{k}" for k in range(4)}

    def stages(before: dict[int, str]) -> list[str]:
        out = [f"({h} * b.close + {g} * {before[0]})"]
        for k in range(1, 4):
            out.append(f"(-{g} * {out[k - 1]} + {before[k - 1]} + {g} * {before[k]})")
        return out

    zero = {k: number(0) for k in range(4)}
    q.fold({f"l{k}": (a, b) for k, (a, b) in enumerate(zip(stages(zero), stages(prev)))})
    q.cols(cu="greatest(l0 - l1, 0) + greatest(l1 - l2, 0) + greatest(l2 - l3, 0)", cd="greatest(l1 - l0, 0) + greatest(l2 - l1, 0) + greatest(l3 - l2, 0)")
    q.fold({"su": (f"{h} * b.cu", f"{h} * b.cu + {g} * p.su"), "sd": (f"{h} * b.cd", f"{h} * b.cd + {g} * p.sd")})
    return {"line": "CASE WHEN su + sd = 0 THEN 50 ELSE 100 * su / (su + sd) END"}


@oracle("MomentumOfMovingAverage")
def _(q, p):
    n = p["length"]
    more = f"list_append(p.w, b.close)[greatest(len(p.w) + 2 - {n}, 1):]"
    full = f"len({more}) = {n}"
    mean = f"list_sum({more}) / {n}"
    after = f"CASE WHEN {full} THEN list_append({more}, {mean})[2:] ELSE {more} END"
    q.fold({"w": ("[b.close]", after), "m": ("CAST(NULL AS DOUBLE)", f"CASE WHEN {full} THEN {mean} END")})
    return {"line": "100 * (m - w[1]) / nullif(w[1], 0)"}


def _macd(q: Query, a: int, b: int, relative: bool = False, signal: int = 0) -> None:
    q.smooth("f", "close", a)
    q.smooth("s", "close", b)
    q.cols(m="100 * (f - s) / nullif(s, 0)" if relative else "f - s")
    if signal:
        q.smooth("g", "m", signal)


for _name, _key, _relative, _a, _b in (
    ("MovingAverageConvergenceDivergence", "macd", False, "shortMaLength", "longMaLength"), ("PercentagePriceOscillator", "ppo", True, "shortPeriod", "longPeriod"),
):

    def _plain(q, p, key=_key, relative=_relative, a=_a, b=_b):
        _macd(q, p[a], p[b], relative)
        return {key: "m"}

    def _signal(q, p, key=_key, relative=_relative, a=_a, b=_b):
        _macd(q, p[a], p[b], relative, p["signalMaLength"])
        return {key: "m", "signal": "g"}

    def _histogram(q, p, build=_signal):
        return {**build(q, p), "histogram": "m - g"}

    FOLDS[_name], FOLDS[_name + "Signal"], FOLDS[_name + "Histogram"] = _plain, _signal, _histogram


@oracle("PsychologicalLine")
def _(q, p):
    n = p["length"]
    q.cols(c1=Q.lag("close"), cn=Q.lag("close", n))
    q.cols(k="CASE WHEN close > c1 THEN 1 ELSE 0 END - CASE WHEN cn < c1 THEN 1 ELSE 0 END")
    return {"line": f"CASE WHEN i >= {n - 1} THEN CAST({Q.cumulative('k')} AS DOUBLE) / {n} END"}


@oracle("Trix")
def _(q, p):
    for a, b in (("e1", "close"), ("e2", "e1"), ("e3", "e2")):
        q.smooth(a, b, p["length"])
    q.cols(b=Q.lag("e3", p["rocLength"]))
    return {"line": "1000 * (e3 - b) / nullif(b, 0)"}


@oracle("TrueStrengthIndex")
def _(q, p):
    q.cols(d=f"close - {Q.lag('close')}")
    q.cols(ad="abs(d)")
    for a, b, n in (("f1", "d", "first"), ("f2", "ad", "first"), ("g1", "f1", "second"), ("g2", "f2", "second")):
        q.smooth(a, b, p[f"{n}Length"], warm="part")
    q.cols(v=f"CASE WHEN i >= {p['secondLength']} THEN coalesce(100 * g1 / nullif(g2, 0), 0) END")
    q.smooth("s", "v", p["signalLength"])
    return {"tsi": "v", "signal": "s"}


@oracle("WaveTrendOscillator")
def _(q, p):
    n = p["averagePeriod"]
    q.cols(tp=TP)
    q.smooth("e", "tp", p["esaPeriod"])
    q.cols(df="abs(tp - e)")
    q.smooth("d", "df", p["dPeriod"])
    q.cols(w="(tp - e) / nullif(0.015 * d, 0)")
    return {"wt1": "w", "wt2": f"CASE WHEN w IS NOT NULL THEN sum(w) {Q.over(n)} / {n} END"}


@oracle("AdaptivePriceZone")
def _(q, p):
    n, k = p["period"], number(p["bandPercentage"])
    q.smooth("e", "close", n)
    q.cols(s=Q.deviation("close", n))
    return {"ma": "e", "upper": f"e + {k} * s", "lower": f"e - {k} * s"}


@oracle("AverageTrueRange")
def _(q, p):
    _reach(q)
    q.smooth("v", "tr", p["length"], 1 / p["length"])
    return {"line": "v"}


@oracle("ChaikinVolatility")
def _(q, p):
    q.cols(r="high - low")
    q.smooth("e", "r", p["emaLength"])
    q.cols(b=Q.lag("e", p["rocLength"]))
    return {"line": "100 * (e - b) / nullif(b, 0)"}


@oracle("KeltnerChannels")
def _(q, p):
    n, k = p["length"], number(p["multiplier"])
    _reach(q)
    q.smooth("e", "close", n)
    q.smooth("a", "tr", n, 1 / n, "mean")
    return {"upper": f"e + {k} * a", "middle": "e", "lower": f"e - {k} * a"}


@oracle("MassIndex")
def _(q, p):
    q.cols(r="high - low")
    q.smooth("a", "r", p["emaLength"], warm="part")
    q.smooth("b", "a", p["emaLength"], warm="part")
    q.cols(v=f"CASE WHEN i >= {p['emaLength'] - 1} THEN a / nullif(b, 0) END")
    return {"line": Q.total("v", p["length"])}


@oracle("ApprovalFlowIndex")
def _(q, p):
    n = p["length"]
    q.cols(c1=Q.lag("close"), cf=f"max(CASE WHEN i = {n - 1} THEN close END) OVER (PARTITION BY symbol)")
    q.cols(base=f"CASE WHEN i > {n} THEN cf ELSE c1 END")
    q.cols(a="CASE WHEN close > base THEN volume ELSE 0 END", z="CASE WHEN close < base THEN volume ELSE 0 END")
    q.cols(u=Q.cumulative("a"), v=Q.cumulative("z"))
    return {"line": f"CASE WHEN i >= {n} THEN 100 * (u - v) / nullif(u + v, 0) END"}


@oracle("DemandIndex")
def _(q, p):
    n = p["length"]
    lp, lv = "ln(abs(b.close - p.ac))", "ln(abs(b.volume - p.av))"
    moves = "(p.ac <> 0 AND p.av <> 0 AND b.close <> p.ac AND b.volume <> p.av)"
    unset = "(p.ac = 0 OR p.av = 0)"
    raw = f"CASE WHEN {lp} = {lv} THEN 0 ELSE {lp} * {lv} / ({lp} - {lv}) * sign(b.close - p.ac) END"
    more = f"CASE WHEN {moves} THEN list_append(p.w, {raw})[greatest(len(p.w) + 2 - {n}, 1):] ELSE p.w END"
    value = f"CASE WHEN {unset} THEN NULL WHEN {moves} THEN CASE WHEN len({more}) = {n} THEN list_sum({more}) / {n} END ELSE p.held END"
    q.fold({
        "ac": ("b.close", f"CASE WHEN {moves} OR {unset} THEN b.close ELSE p.ac END"),
        "av": ("b.volume", f"CASE WHEN {moves} OR {unset} THEN b.volume ELSE p.av END"),
        "w": ("CAST([] AS DOUBLE[])", more),
        "v": ("CAST(NULL AS DOUBLE)", value),
        "held": ("CAST(NULL AS DOUBLE)", f"coalesce({value}, p.held)"),
    })
    return {"line": "v"}


@oracle("EaseOfMovement")
def _(q, p):
    n = p["length"]
    can = "(p.ph <> 0 AND p.pl <> 0 AND b.high <> b.low AND b.volume <> 0)"
    move = "((b.high + b.low) / 2 - (p.ph + p.pl) / 2) * (b.high - b.low) / b.volume"
    more = f"CASE WHEN {can} THEN list_append(p.w, {move})[greatest(len(p.w) + 2 - {n}, 1):] ELSE p.w END"
    value = f"CASE WHEN {can} AND len({more}) = {n} THEN list_sum({more}) / {n} END"
    q.fold({
        "ph": ("b.high", f"CASE WHEN {value} IS NULL THEN b.high ELSE p.ph END"), "pl": ("b.low", f"CASE WHEN {value} IS NULL THEN b.low ELSE p.pl END"),
        "w": ("CAST([] AS DOUBLE[])", more), "v": ("CAST(NULL AS DOUBLE)", value),
    })
    return {"line": "v"}


@oracle("ForceIndex")
def _(q, p):
    q.cols(f=f"(close - {Q.lag('close')}) * volume")
    q.smooth("v", "f", p["length"])
    return {"line": "v"}


FOLDS["ElderForceIndex"] = FOLDS["ForceIndex"]


@oracle("KlingerVolumeOscillator")
def _(q, p):
    q.cols(tp=TP)
    q.cols(sv=f"CASE WHEN tp > coalesce({Q.lag('tp')}, 0) THEN volume ELSE -volume END")
    q.smooth("a", "sv", p["shortPeriod"])
    q.smooth("b", "sv", p["longPeriod"])
    return {"shortEma": "a", "longEma": "b", "oscillator": "a - b"}


@oracle("PercentageVolumeOscillator")
def _(q, p):
    q.smooth("a", "volume", p["shortPeriod"])
    q.smooth("b", "volume", p["longPeriod"])
    return {"shortEma": "a", "longEma": "b", "pvo": "CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN coalesce(100 * (a - b) / nullif(b, 0), 0) END"}


def _volume_index(sign: str):
    def build(q, p):
        q.cols(c1=Q.lag("close"), v1=Q.lag("volume"))
        moved = f"b.volume {sign} b.v1 AND b.c1 <> 0 AND b.v1 <> 0 AND b.volume <> 0"
        q.fold({"v": (number(1000), f"CASE WHEN {moved} THEN p.v + p.v * (b.close - b.c1) / b.c1 ELSE p.v END")})
        return {"line": "v"}

    return build


FOLDS["NegativeVolumeIndex"], FOLDS["PositiveVolumeIndex"] = _volume_index("<"), _volume_index(">")


@oracle("TwiggsMoneyFlow")
def _(q, p):
    q.cols(raw="volume * (2 * (high + low + close) / 3 - high - low) / nullif(high - low, 0)")
    q.cols(ad=f"coalesce(last_value(raw IGNORE NULLS) {Q.so_far}, 0)")
    q.smooth("a", "ad", p["length"])
    q.smooth("b", "volume", p["length"])
    return {"line": "nullif(a / nullif(b, 0), 0)"}


for _id, _out in (("BearPower", {"line": "low - e"}), ("BullPower", {"line": "high - e"}), ("ElderRay", {"bull": "high - e", "bear": "low - e"})):

    def _power(q, p, out=_out):
        q.smooth("e", "close", p["length"])
        return out

    FOLDS[_id] = _power


@oracle("McClellanOscillator")
def _(q, p):
    q.smooth("a", "close", p["ema19Length"])
    q.smooth("b", "close", p["ema39Length"])
    return {"line": "a - b"}


@oracle("McGinleyDynamic")
def _(q, p):
    n = p["length"]
    scale = f"(0.6 * {n} * pow(b.close / p.v, 4))"
    q.cols(seed=f"avg(close) {Q.over(n)}")
    step = f"p.v + (b.close - p.v) / {scale}"
    value = f"CASE WHEN b.i < {n} THEN b.seed WHEN p.v = 0 THEN b.close WHEN isfinite({scale}) AND {scale} <> 0 AND isfinite({step}) THEN {step} END"
    q.fold({"v": ("b.seed", f"coalesce({value}, p.v)"), "o": ("CAST(NULL AS DOUBLE)", value)})
    return {"line": f"CASE WHEN i >= {n - 1} THEN o END"}


@oracle("EhlersFisherTransform")
def _(q, p):
    n = p["length"]
    q.cols(m=HL2)
    q.cols(hi=Q.high("high", n), lo=Q.low("low", n))
    q.cols(x="coalesce((m - lo) / nullif(hi - lo, 0), 0.5)")
    q.fold({"v": (number(0), f"CASE WHEN b.i < {n - 1} THEN 0 ELSE greatest(-0.999, least(0.999, 0.33 * (b.x - 0.5) + 0.67 * p.v)) END")})
    q.cols(f="0.5 * ln((1 + v) / (1 - v))")
    return {"main": f"CASE WHEN i >= {n - 1} THEN f END", "trigger": f"CASE WHEN i >= {n - 1} THEN coalesce({Q.lag('f')}, 0) END"}


@oracle("SchaffTrendCycle")
def _(q, p):
    n, k = p["length"], p["stochasticKLength"]
    _macd(q, p["shortMaLength"], p["longMaLength"], signal=p["signalMaLength"])
    q.cols(h="m - g", hi=f"max(close) {Q.over(n)}", lo=f"min(close) {Q.over(n)}")
    q.cols(raw="(h - lo) / nullif(hi - lo, 0)")
    q.cols(kh=Q.high("raw", k), kl=Q.low("raw", k))
    q.cols(st="CASE WHEN kh IS NOT NULL THEN coalesce(100 * (raw - kl) / nullif(kh - kl, 0), 0) END")
    q.smooth("v", "st", n)
    return {"line": "v"}


@oracle("ParabolicSar")
def _(q, p):
    first, more, most = (number(p[k]) for k in ("acceleration", "accelerationStep", "accelerationMax"))
    q.cols(h1=Q.lag("high"), l1=Q.lag("low"), h2=Q.lag("high", 2), l2=Q.lag("low", 2))
    old = q.last
    # Bar 1 opens; later bars move the stop on (a), turn and clip it (c), and see whether it is crossed.
    opened = (
        f"SELECT symbol, i, lg, ext, CAST({first} AS DOUBLE) AS af, ext + CASE WHEN lg THEN -1 ELSE 1 END * (greatest(high, h1) - least(low, l1)) * {first} AS v "
        f"FROM (SELECT *, high > h1 AS lg, CASE WHEN high > h1 THEN greatest(high, h1) ELSE least(low, l1) END AS ext FROM {old} WHERE i = 1)"
    )
    moved = (
        "SELECT b.symbol, b.i, b.high, b.low, b.h1, b.l1, b.h2, b.l2, p.lg, p.ext, p.af, "
        "CASE WHEN p.lg THEN least(p.v + p.af * (p.ext - p.v), b.low, b.l1) ELSE greatest(p.v + p.af * (p.ext - p.v), b.high, b.h1) END AS a "
        f"FROM sar p JOIN {old} b ON b.symbol = p.symbol AND b.i = p.i + 1"
    )
    kept = f"SELECT *, CASE WHEN lg THEN low > a ELSE high < a END AS ok FROM ({moved})"
    turned = (
        "SELECT *, CASE WHEN ok THEN lg ELSE NOT lg END AS lg1, CASE WHEN ok THEN ext WHEN lg THEN low ELSE high END AS e1, "
        f"CASE WHEN ok THEN af ELSE {first} END AS f1, CASE WHEN ok THEN a ELSE ext END AS s1 FROM ({kept})"
    )
    clipped = f"SELECT *, CASE WHEN lg1 THEN least(s1, l1, l2) ELSE greatest(s1, h1, h2) END AS c FROM ({turned})"
    crossed = f"SELECT *, CASE WHEN lg1 THEN least(low, l1) < c ELSE greatest(high, h1) > c END AS x FROM ({clipped})"
    further = f"SELECT *, CASE WHEN lg1 THEN high > e1 ELSE low < e1 END AS more FROM ({crossed})"
    side = "CASE WHEN {0} THEN high ELSE low END"
    later = (
        f"SELECT symbol, i, CASE WHEN x THEN NOT lg1 ELSE lg1 END, CASE WHEN x THEN {side.format('NOT lg1')} WHEN more THEN {side.format('lg1')} ELSE e1 END, "
        f"CASE WHEN x THEN {first} WHEN more THEN least({most}, f1 + {more}) ELSE f1 END, CASE WHEN x THEN e1 ELSE c END FROM ({further})"
    )
    q._add(f"SELECT a.*, r.v FROM {old} a LEFT JOIN sar r USING (symbol, i)", f"sar AS ({opened} UNION ALL {later})")
    return {"value": "nullif(v, 0)"}


def turns_sql(field: str, sides: tuple[int, ...], share: float, both: bool) -> str:
    """Reversals of one price as events."""
    q = Query()
    x = f"b.{field}"
    ext0 = f"coalesce(p.ext, {x})"
    up0 = f"coalesce(p.up, {x} >= p.pv)"
    raised = f"CASE WHEN {up0} THEN greatest({ext0}, {x}) ELSE least({ext0}, {x}) END"
    turned = (
        f"CASE WHEN {up0} THEN {ext0} >= {x} AND {x} <= {ext0} - {ext0} * {number(share)} "
        f"ELSE {ext0} <= {x} AND {x} >= {ext0} + {ext0} * {number(share)} END"
    )
    accepted = " OR ".join([f"{up0}" if s > 0 else f"NOT ({up0})" for s in sides])
    target = f"CASE WHEN {str(both).lower()} AND {ext0} = 0 THEN b.i ELSE b.i - p.sh END"
    q.fold({
        "pv": (x, x),
        "ext": ("CAST(NULL AS DOUBLE)", f"CASE WHEN {turned} THEN {x} ELSE {raised} END"),
        "up": ("CAST(NULL AS BOOLEAN)", f"CASE WHEN {turned} THEN NOT ({up0}) ELSE {up0} END"),
        "sh": ("CAST(0 AS BIGINT)", f"CASE WHEN {turned} THEN 1 ELSE p.sh + 1 END"),
        "ev": ("CAST(NULL AS DOUBLE)", f"CASE WHEN {turned} AND ({accepted}) THEN {ext0} END"),
        "tg": ("CAST(NULL AS BIGINT)", f"CASE WHEN {turned} AND ({accepted}) THEN {target} END"),
    })
    return (
        f"WITH RECURSIVE {', '.join(q.parts)} SELECT symbol, 'value' AS output_id, i AS source_index, tg AS target_index, "
        f"greatest(i, tg) AS report_index, round(ev, {DIGITS}) AS value FROM {q.last} WHERE ev IS NOT NULL"
    )


def fractals_sql(n: int) -> str:
    q = Query()
    half = n // 2
    tests = {}
    for name, x, op in (("up", "high", ">"), ("dn", "low", "<")):
        at = lambda k, x=x: Q.lag(x, k)
        rises = [f"({at(k)} {op} {at(k + 1)})" for k in range(half, n - 1)]
        falls = [f"({at(k + 1)} {op} {at(k)})" for k in range(half)]
        tests[name] = f"coalesce({' AND '.join(rises + falls)}, false)"
    q.cols(**tests, mh=Q.lag("high", half), ml=Q.lag("low", half))
    states = {}
    for name in ("up", "dn"):
        hit = f"(b.{name} AND p.c{name} + 1 >= {n})"
        states[f"c{name}"] = ("CAST(1 AS BIGINT)", f"CASE WHEN {hit} THEN 0 ELSE p.c{name} + 1 END")
        states[f"h{name}"] = ("false", hit)
    q.fold(states)
    one = lambda out, x, name: (
        f"SELECT symbol, '{out}' AS output_id, i AS source_index, i - {half} AS target_index, i AS report_index, round({x}, {DIGITS}) AS value "
        f"FROM {q.last} WHERE h{name}"
    )
    return f"WITH RECURSIVE {', '.join(q.parts)} {one('up', 'mh', 'up')} UNION ALL {one('down', 'ml', 'dn')}"


def event_sql(wanted: Request) -> str:
    p = wanted.resolved
    if wanted.definition.id == "Fractals":
        return fractals_sql(p["length"])
    field, sides = {"ZigZag": ("close", (1, -1)), "Peak": ("high", (1,)), "Trough": ("low", (-1,))}[wanted.definition.id]
    return turns_sql(field, sides, p["deviation"], len(sides) == 2)
