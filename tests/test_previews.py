"""Bars that are still forming: what each indicator gives for them, against loops over bars that share no code with the engine."""

import math
import pickle
import statistics

import pytest

from tests.test_indicators import SCHEMA, smooth
from tidemark.catalog import DEFINITIONS
from tidemark.operators.recursive import RECURSIVE, Bar
from tidemark.operators.windowed import WINDOWED
from tidemark.plans.planner import compute, preview, request

N = 130
ROWS = smooth(N)
P = {name: DEFINITIONS[name].resolve() for name in (*WINDOWED, *RECURSIVE)}


def probes(rows):
    """Far down, far up, and flat at the last close."""
    close, time = rows[-1][5], rows[-1][1] + 60
    return [
        ("x", time, close - 12, close, close - 12, close - 12, 1.0),
        ("x", time, close + 12, close + 12, close, close + 12, 90000.0),
        ("x", time, close, close, close, close, 5000.0),
    ]


def column(rows, k):
    return [r[k] for r in rows]


def mean(xs):
    return math.fsum(xs) / len(xs)


def before(x, n):
    """The n last final values."""
    return x[-n - 1 : -1]


# Each takes the final bars and the forming one after them, as columns, and parameters.
LOOPS = {}


def loop(name):
    def keep(f):
        LOOPS[name] = f
        return f

    return keep


@loop("Highest")
def _(o, h, l, c, v, p):
    return (max(c[-p["length"] - 1 :]),)


@loop("Lowest")
def _(o, h, l, c, v, p):
    return (min(c[-p["length"] - 1 :]),)


@loop("PriceChannels")
def _(o, h, l, c, v, p):
    return max(h[-p["length"] - 1 :]), min(l[-p["length"] - 1 :])


@loop("DonchianChannels")
def _(o, h, l, c, v, p):
    n = p["length"]
    return max(h[-n - 1 :]), (max(before(h, n)) + min(before(l, n))) / 2, min(l[-n - 1 :])


@loop("WilliamsR")
def _(o, h, l, c, v, p):
    top, bottom = max(h[-p["length"] - 1 :]), min(l[-p["length"] - 1 :])
    return (-100 * (top - c[-1]) / (top - bottom),)


@loop("StochasticK")
def _(o, h, l, c, v, p):
    top, bottom = max(h[-p["length"] - 1 :]), min(l[-p["length"] - 1 :])
    return (100 * (c[-1] - bottom) / (top - bottom),)


@loop("Momentum")
def _(o, h, l, c, v, p):
    return (c[-1] - c[-2 - p["length"]],)


@loop("RateOfChange")
def _(o, h, l, c, v, p):
    base = c[-2 - p["length"]]
    return (100 * (c[-1] - base) / base,)


@loop("SimpleMovingAverage")
def _(o, h, l, c, v, p):
    return (mean(c[-p["length"] :]),)


@loop("BollingerBands")
def _(o, h, l, c, v, p):
    held = before(c, p["length"])
    middle, width = mean(held), statistics.pstdev(held)
    return middle + p["upBandWidth"] * width, mean(c[-p["length"] :]), middle + p["lowBandWidth"] * width


@loop("BollingerPercentB")
def _(o, h, l, c, v, p):
    held = before(c, p["length"])
    middle, width = mean(held), p["stdDevMultiplier"] * statistics.pstdev(held)
    return (100 * (c[-1] - (middle - width)) / (2 * width),)


@loop("KaufmanEfficiencyRatio")
def _(o, h, l, c, v, p):
    path = c[-p["length"] - 1 :]
    return (abs(path[-1] - path[0]) / sum(abs(b - a) for a, b in zip(path, path[1:])),)


@loop("DetrendedPriceOscillator")
def _(o, h, l, c, v, p):
    n = p["length"]
    means = [mean(c[k - n + 1 : k + 1]) for k in range(n - 1, len(c) - 1)][-n:]
    return (c[-1] - means[max(0, len(means) - 1 - (n // 2 + 1))],)


@loop("MomentumPinball")
def _(o, h, l, c, v, p):
    held = before(c, p["length"])
    return (100 * (c[-1] - held[0]) / (max(held) - min(held)),)


@loop("FiniteVolumeElement")
def _(o, h, l, c, v, p):
    raw = [0.0 if a == b or not x else 2 * (d - b) / (a - b) - 1 for a, b, d, x in zip(h, l, c, v)]
    return (100 * mean([*before(raw, p["length"])[:-1], raw[-1]]),)


@loop("RelativeMomentumIndex")
def _(o, h, l, c, v, p):
    n, k = p["length"], p["momentumPeriod"]
    moves = [c[i] - c[i - k] for i in range(len(c) - n, len(c) - 1)] + [c[-1] - c[-2 - k]]
    up, down = (mean([max(s * m, 0) for m in moves]) for s in (1, -1))
    return (100 * up / (up + down) if up + down else None,)


@loop("BalanceOfPower")
def _(o, h, l, c, v, p):
    return (None,)


@loop("FibonacciRetracement")
def _(o, h, l, c, v, p):
    top, bottom = max(h[-p["length"] - 1 :]), min(l[-p["length"] - 1 :])
    return tuple(bottom + (top - bottom) * x for x in (0.236, 0.382, 0.5, 0.618, 0.786))


@loop("Aroon")
def _(o, h, l, c, v, p):
    """Ages as long as no extreme has left the window: held against short series only."""
    n = p["length"]

    def age(x, s):
        held = [s * y for y in before(x, n)]
        return 0 if s * x[-1] > max(held) else n - 1 - max(k for k, y in enumerate(held) if y == max(held)) + 1

    return 100 * (n - age(h, 1)) / n, 100 * (n - age(l, -1)) / n


@loop("EhlersFisherTransform")
def _(o, h, l, c, v, p):
    n, value, fisher, last = p["length"], 0.0, 0.0, 0.0
    for k in range(n - 1, len(c)):
        top, bottom = (max(h[k - n + 1 : k + 1]), min(l[k - n + 1 : k + 1])) if k < len(c) - 1 else (max(before(h, n)), min(before(l, n)))
        base = 0 if top == bottom else 0.5 * (((h[k] + l[k]) / 2 - bottom) / (top - bottom) - 0.5)
        value = max(-0.999, min(0.999, 0.66 * base + 0.67 * value))
        last, fisher = fisher, 0.5 * math.log((1 + value) / (1 - value))
    return fisher, last


@loop("EaseOfMovement")
def _(o, h, l, c, v, p):
    n, held, high, low = p["length"], [], 0.0, 0.0
    for k in range(len(c)):
        move = ((h[k] + l[k]) / 2 - (high + low) / 2) * (h[k] - l[k]) / v[k] if high and low and h[k] != l[k] and v[k] else None
        if k == len(c) - 1:
            return (None if move is None else (sum(held) + move) / n,)
        if move is not None:
            held = [*held, move][-n:]
        if move is None or len(held) < n:
            high, low = h[k], l[k]


@loop("PsychologicalLine")
def _(o, h, l, c, v, p):
    """As the count of final bars stands, which a fold has; a forming bar that rises adds one."""
    n, held, ups = p["length"], [], 0
    for x in c[:-1]:
        if len(held) == n and held[0] < held[-1]:
            ups -= 1
        ups += bool(held) and x > held[-1]
        held = [*held, x][-n:]
    return ((ups + (c[-1] > held[-1])) / n,)


@loop("Trix")
def _(o, h, l, c, v, p):
    x = list(c)
    for _ in range(3):
        n, out, value = p["length"], [], None
        for k, y in enumerate(x):
            value = None if k < n - 1 else mean(x[:n]) if k == n - 1 else value + (y - value) * 2 / (n + 1)
            out.append(value)
        x = [y for y in out if y is not None]
    base = x[-2 - p["rocLength"]]
    return (1000 * (x[-1] - base) / base,)


@loop("KaufmanAdaptiveMovingAverage")
def _(o, h, l, c, v, p):
    n, fast, slow = p["length"], 2 / (p["fastSCPeriod"] + 1), 2 / (p["slowSCPeriod"] + 1)
    value = c[n]
    for k in range(n + 1, len(c)):
        path = c[k - n - (k == len(c) - 1) : k + 1]
        way = sum(abs(b - a) for a, b in zip(path, path[1:]))
        value += (c[k] - value) * ((abs(path[-1] - path[0]) / way if way else 0) * (fast - slow) + slow) ** 2
    return (value,)


@loop("GatorOscillator")
def _(o, h, l, c, v, p):
    m = [(a + b) / 2 for a, b in zip(h, l)][:-1]

    def drawn(n, shift):
        value, out = None, []
        for k, y in enumerate(m):
            value = mean(m[: k + 1]) if k == n - 1 else None if k < n else (value * (n - 1) + y) / n
            out.append(value)
        return out[-1 - shift]

    jaw, teeth, lips = (drawn(p[f"{x}Length"], p[f"{x}Shift"]) for x in ("jaw", "teeth", "lips"))
    return abs(jaw - lips), -abs(lips - teeth)


def same(found, wanted):
    return len(found) == len(wanted) and all((a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))) for a, b in zip(found, wanted))


def series_for(name):
    """Aroon's loop holds where ages have not been counted from the window's old end, as on a rise."""
    if name != "Aroon":
        return ROWS
    return [("x", 60 * i, 100.0 + i, 101.0 + i, 99.0 + (i if i < 3 else -3), 100.0 + i, 10.0) for i in range(15)]


@pytest.fixture(scope="module")
def previewed(spark):
    """Values for each probe, of all window formulas and folds in one plan."""
    wanted = [request(name, f"{name}_") for name in (*sorted(WINDOWED), *sorted(RECURSIVE))]
    final = spark.createDataFrame([(f"{k}", *r[1:]) for k in range(3) for r in ROWS], SCHEMA)
    forming = spark.createDataFrame([(f"{k}", *r[1:]) for k, r in enumerate(probes(ROWS))], SCHEMA)
    return {r.symbol: r.asDict() for r in preview(final, forming, wanted).collect()}


@pytest.mark.parametrize("name", sorted(LOOPS))
def test_previews_as_loops_have_them(previewed, name):
    rows = series_for(name)
    for k, probe in enumerate(probes(rows)):
        wanted = LOOPS[name](*[column([*rows, probe], c) for c in range(2, 7)], P[name])
        if rows is ROWS:
            names = request(name, f"{name}_").columns
            assert same([previewed[str(k)][c] for c in names], wanted), (name, k)
        if name in RECURSIVE:
            fold = RECURSIVE[name](P[name])
            for i, r in enumerate(rows):
                fold.commit(Bar(i, *r[1:]))
            assert same(fold.preview(Bar(len(rows), *probe[1:])), wanted), (name, k)


@pytest.mark.parametrize("name", sorted(RECURSIVE))
def test_a_preview_changes_nothing_and_forms_no_line(name):
    fold, seen = RECURSIVE[name](P[name]), set()
    for i, r in enumerate(ROWS):
        state = pickle.dumps(vars(fold))
        found = fold.preview(Bar(i, *r[1:]))
        assert pickle.dumps(vars(fold)) == state
        if not fold.standing:
            assert {k for k, x in enumerate(found) if x is not None} <= seen
        seen |= {k for k, x in enumerate(fold.commit(Bar(i, *r[1:]))) if x is not None}


def test_no_window_line_starts_on_a_forming_bar(spark, previewed):
    """On each of the first bars: what has no value on the bars before has none while the next one forms."""
    wanted = [request(name, f"{name}_") for name in sorted(WINDOWED) if name not in ("Ichimoku", "Shift")]
    names = [c for r in wanted for c in r.columns]
    lengths = (1, 2, 3, 5, 9, 14, 15, 20, 33, 40, 60)
    cut = [(f"{n}", *r[1:]) for n in lengths for r in ROWS[:n]]
    forming = [(f"{n}", *ROWS[n][1:]) for n in lengths]
    found = {r.symbol: r for r in preview(spark.createDataFrame(cut, SCHEMA), spark.createDataFrame(forming, SCHEMA), wanted).collect()}
    batch = sorted(compute(spark.createDataFrame(ROWS, SCHEMA), wanted).collect(), key=lambda r: r.time)
    for n in lengths:
        there = {c for c in names if any(r[c] is not None for r in batch[:n])}
        assert {c for c in names if found[str(n)][c] is not None} <= there
