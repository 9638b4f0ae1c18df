"""Window indicators on gaps and flat bars, against loops over bars that share no code with their formulas."""

import math
from collections import deque

import pytest

from tests.test_indicators import SCHEMA, shapes, smooth
from tidemark.catalog import DEFINITIONS
from tidemark.operators.windowed import WINDOWED
from tidemark.plans.planner import compute, request

P = {name: DEFINITIONS[name].resolve() for name in WINDOWED}
LOOPS = {}


def loop(name):
    def keep(f):
        LOOPS[name] = f
        return f

    return keep


def there(*xs):
    return all(x is not None for x in xs)


def ratio(a, b, zero=None):
    return None if a is None or b is None else zero if b == 0 else a / b


class Last:
    """The last n pushed values; a sum, mean, highest or lowest only if it is full and nothing is missing."""

    def __init__(self, n):
        self.n, self.q = n, deque(maxlen=n)

    def push(self, x):
        self.q.append(x)
        return self

    @property
    def full(self):
        return len(self.q) == self.n and there(*self.q)

    def of(self, f):
        return f(self.q) if self.full else None

    @property
    def mean(self):
        return self.of(lambda q: math.fsum(q) / self.n)


@loop("TrueRange")
def true_range(bars, p):
    before = None
    for o, h, l, c, v in bars:
        if not there(h, l):
            yield (None,)
            continue
        yield (None if before is None else max(h - l, abs(before - h), abs(before - l)),)
        before = c if c is not None else before


@loop("BalanceVolume")
def balance_volume(bars, p):
    before = total = 0
    for o, h, l, c, v in bars:
        if before == 0:
            before = c or 0
            yield (None,)
        elif there(c, v):
            total += v * ((c > before) - (c < before))
            before = c
            yield (total,)
        else:
            yield (None,)


@loop("OnBalanceVolume")
def on_balance_volume(bars, p):
    before = total = 0
    for o, h, l, c, v in bars:
        if there(c, v):
            if before:
                total += v * ((c > before) - (c < before))
            before = c
        yield (total if there(c, v) else None,)


@loop("OnBalanceVolumeMean")
def on_balance_volume_mean(bars, p):
    w = Last(p["length"])
    for (x,) in on_balance_volume(bars, p):
        yield (w.push(x).mean,)


@loop("PriceVolumeTrend")
def price_volume_trend(bars, p):
    before = total = 0
    for o, h, l, c, v in bars:
        out = None
        if there(c, v):
            if before:
                total += v * (c - before) / before
                out = total
            before = c
        yield (out,)


@loop("VolumeWeightedAveragePrice")
def vwap(bars, p):
    money = volume = 0
    for o, h, l, c, v in bars:
        if there(h, l, c, v):
            money, volume = money + (h + l + c) / 3 * v, volume + v
        yield (money / volume if volume > 0 else None,)


@loop("TimeWeightedAveragePrice")
def twap(bars, p):
    seen = []
    for o, h, l, c, v in bars:
        if there(h, l, c):
            seen.append((h + l + c) / 3)
        yield (math.fsum(seen) / len(seen) if there(h, l, c) else None,)


@loop("WilliamsAccumulationDistribution")
def williams(bars, p):
    before = total = 0
    for o, h, l, c, v in bars:
        out = None
        if c is not None and before and there(h, l):
            total += c - min(l, before) if c > before else c - max(h, before) if c < before else 0
            out = total
        before = before if c is None else c
        yield (out,)


@loop("ChaikinMoneyFlow")
def chaikin(bars, p):
    w, above, below = Last(p["length"]), 0, 0
    for o, h, l, c, v in bars:
        flow = None if not there(h, l, c, v) else 0 if h == l else ((c - l) - (h - c)) / (h - l) * v
        gone = w.q[0] if len(w.q) == w.n else None
        above, below = above + (flow or 0) - (gone or 0), below + (0 if flow is None else v) - (gone or 0)
        yield (ratio(above, below, 0) if w.push(flow).full else None,)


@loop("MoneyFlowIndex")
def money_flow(bars, p):
    gains, losses, before = Last(p["length"]), Last(p["length"]), 0
    for o, h, l, c, v in bars:
        t = (h + l + c) / 3 if there(h, l, c, v) else None
        u = gains.push(t * v if t is not None and t > before else 0).of(math.fsum)
        d = losses.push(t * v if t is not None and t < before else 0).of(math.fsum)
        yield (None if t is None or u is None else 100 if d == 0 else ratio(100 * u, u + d),)
        before = before if t is None else t


@loop("RelativeVigorIndex")
def relative_vigor(bars, p):
    w, s = deque(maxlen=p["averageLength"]), deque(maxlen=p["signalLength"])
    head = lambda q: [(x[0] + 2 * x[1] + 2 * x[2] + x[3]) / 6 for x in zip(*[q[k] for k in range(4)])]
    for o, h, l, c, v in bars:
        w.append((c - o, h - l) if there(o, h, l, c) else None)
        rvi = signal = None
        if len(w) == w.maxlen:
            if there(*[w[k] for k in range(4)]):
                a, b = head(w)
                rvi = a if b == 0 else a / b
            s.append(None if rvi is None else (rvi,))
            if len(s) == s.maxlen and there(*[s[k] for k in range(4)]):
                (signal,) = head(s)
        yield rvi, signal


@loop("FibonacciRetracement")
def fibonacci(bars, p):
    w = deque(maxlen=p["length"])
    for o, h, l, c, v in bars:
        w.append((h, l))
        ok = all(there(*x) for x in w)
        hi, lo = (max(x[0] for x in w), min(x[1] for x in w)) if ok else (None, None)
        yield tuple(lo + (hi - lo) * r if ok else None for r in (0.236, 0.382, 0.5, 0.618, 0.786))


@loop("ChandeKrollStop")
def chande_kroll(bars, p):
    hs, ls, a, b = Last(p["period"]), Last(p["period"]), deque(maxlen=p["stopPeriod"]), deque(maxlen=p["stopPeriod"])
    for o, h, l, c, v in bars:
        hi, lo = hs.push(h).of(max), ls.push(l).of(min)
        if hi is None or lo is None:
            yield None, None
            continue
        a.append(hi - (hi - lo) * p["multiplier"])
        b.append(lo + (hi - lo) * p["multiplier"])
        yield math.fsum(a) / p["stopPeriod"], math.fsum(b) / p["stopPeriod"]


@loop("ChoppinessIndex")
def choppiness(bars, p):
    n, before = p["length"], 0
    r, t = Last(n), Last(n)
    for o, h, l, c, v in bars:
        out = None
        if there(h, l, c):
            u, d = t.push(max(h - l, abs(h - before), abs(l - before))).of(math.fsum), r.push(h - l).of(math.fsum)
            out = 100 * math.log10(u / d) / math.log10(n) if u and d and u > 0 and d > 0 else None
            before = c
        yield (out,)


@loop("BalanceOfMarketPower")
def market_power(bars, p):
    w = Last(p["length"])
    for o, h, l, c, v in bars:
        yield (w.push(None if not there(o, h, l, c) else 0 if not v else (c - o) / (0.01 if h == l else h - l)).mean,)


@loop("FiniteVolumeElement")
def finite_volume(bars, p):
    w = Last(p["length"])
    for o, h, l, c, v in bars:
        m = w.push(2 * (c - l) / (h - l) - 1 if there(h, l, c) and v and h != l else 0).mean
        yield (None if m is None else 100 * m,)


@loop("IntradayIntensityIndex")
def intraday_intensity(bars, p):
    w = Last(p["length"])
    for o, h, l, c, v in bars:
        yield (w.push(ratio(2 * ((c - l) - (h - c)), (h - l) * (v or 0), 0) if there(h, l, c) else None).mean,)


@loop("KnowSureThing")
def know_sure_thing(bars, p):
    closes, means, signal = [], [Last(p[f"sma{k}Length"]) for k in range(1, 5)], Last(p["signalLength"])
    for o, h, l, c, v in bars:
        base = [closes[-p[f"roc{k}Length"]] if len(closes) >= p[f"roc{k}Length"] else None for k in range(1, 5)]
        change = [ratio(100 * (c - b), b) if there(c, b) else None for b in base]
        closes.append(c)
        kst = said = None
        if change[3] is not None and len(closes) > p["roc4Length"]:
            got = [w.push(x).mean for w, x in zip(means, change)]
            if there(*got):
                kst = sum(k * x for k, x in enumerate(got, 1))
                said = signal.push(kst).mean
        yield kst, said


@loop("MomentumPinball")
def pinball(bars, p):
    w = Last(p["length"])
    for o, h, l, c, v in bars:
        yield (None if c is None else w.push(c).of(lambda q: ratio(100 * (q[-1] - q[0]), max(q) - min(q), 0)),)


@loop("DetrendedPriceOscillator")
def detrended(bars, p):
    n, w, means = p["length"], Last(p["length"]), []
    for o, h, l, c, v in bars:
        m = w.push(c).mean
        if m is not None:
            means.append(m)
        yield (c - means[len(means) - 1 - min(n - 1, n // 2 + 1)] if c is not None and len(means) >= n else None,)


@loop("KaufmanEfficiencyRatio")
def efficiency(bars, p):
    w = Last(p["length"])
    for o, h, l, c, v in bars:
        yield (w.push(c).of(lambda q: ratio(abs(q[-1] - q[0]), math.fsum(abs(a - b) for a, b in zip(q, list(q)[1:])), 0)),)


@loop("FractalDimension")
def fractal(bars, p):
    n, w = p["length"], Last(p["length"])

    def value(q):
        path, reach = math.fsum(abs(a - b) for a, b in zip(q, list(q)[1:])), max(q) - min(q)
        return 1.5 if path == 0 or reach == 0 else min(2, max(1, 1 + (math.log(path) - math.log(reach)) / math.log(2 * (n - 1))))

    for o, h, l, c, v in bars:
        yield (None if c is None else w.push(c).of(value),)


@loop("DeMarker")
def demarker(bars, p):
    u, d, before = Last(p["length"]), Last(p["length"]), None
    for o, h, l, c, v in bars:
        out = None
        if there(h, l):
            if before:
                x, y = u.push(max(h - before[0], 0)).mean, d.push(max(before[1] - l, 0)).mean
                out = None if x is None else ratio(x, x + y, 0.5)
            before = h, l
        yield (out,)


@loop("UltimateOscillator")
def ultimate(bars, p):
    lengths, before = (7, 14, 28), None
    bp, tr = [Last(n) for n in lengths], [Last(n) for n in lengths]
    for o, h, l, c, v in bars:
        ok = there(h, l, c, before)
        x = [w.push(c - min(l, before) if ok else None).of(math.fsum) for w in bp]
        y = [w.push(max(h, before) - min(l, before) if ok else None).of(math.fsum) for w in tr]
        yield (100 * sum(k * ratio(a, b) for k, a, b in zip((4, 2, 1), x, y)) / 7 if there(*x, *y) and all(y) else None,)
        before = c if there(h, l, c) else before


@loop("VortexIndicator")
def vortex(bars, p):
    a, b, t, before = Last(p["length"]), Last(p["length"]), Last(p["length"]), (None, None, None)
    for o, h, l, c, v in bars:
        ph, pl, pc = before
        ok = there(h, l, ph, pl, pc) and pc != 0
        x = a.push(abs(h - pl) if ok else None).of(math.fsum)
        y = b.push(abs(l - ph) if ok else None).of(math.fsum)
        z = t.push(max(h - l, abs(h - pc), abs(l - pc)) if ok else None).of(math.fsum)
        yield ratio(x, z, 0), ratio(y, z, 0)
        before = h, l, c


@loop("WoodiesCCI")
def woodies(bars, p):
    n, w, s = p["length"], Last(p["length"]), Last(p["smaLength"])
    for o, h, l, c, v in bars:
        w.push((h + l + c) / 3 if there(h, l, c) else None)
        m = w.mean
        spread = None if m is None or max(w.q) == min(w.q) else math.fsum(abs(x - m) for x in w.q) / n
        cci = None if spread is None else (w.q[-1] - m) / (0.015 * spread)
        yield cci, None if cci is None else s.push(cci).mean


@loop("MarketMeannessIndex")
def meanness(bars, p):
    n, w = p["length"], Last(p["length"])

    def value(q):
        q = list(q)
        signs = [(b > a) - (b < a) for a, b in zip(q, q[1:])]
        return ratio(100 * sum(a != 0 and a != b for a, b in zip(signs, signs[1:])), sum(s != 0 for s in signs), 0)

    for o, h, l, c, v in bars:
        yield (None if c is None else w.push(c).of(value),)


def gapped(rows, places, fields):
    """Rows with nulls in some of open, high, low, close and volume (2 to 6)."""
    return [tuple(None if i in places and k in fields else x for k, x in enumerate(r)) for i, r in enumerate(rows)]


GAPS = {"whole": range(2, 7), "close": (5,), "range": (3, 4), "volume": (6,), "open": (2,)}
N, AT = 800, (2, 20, 40, 41, 150)


@pytest.fixture(scope="module")
def got(spark):
    rows = [r for r in smooth(N, symbol="none")]
    for kind, fields in GAPS.items():
        rows += gapped(smooth(N, symbol=kind), AT, fields) + gapped(smooth(N, symbol=kind + "-first"), (0, 1), fields)
    rows += [(f"shape-{r[0]}", *r[1:]) for r in shapes()] + [("flat", 60 * i, 5.0, 5.0, 5.0, 5.0, 10.0) if i % 30 else ("flat", 60 * i, 5.0, 6.0, 4.0, 5.5, 10.0) for i in range(90)]
    made = compute(spark.createDataFrame(rows, SCHEMA), [request(n, f"{n}_") for n in WINDOWED]).collect()
    by = {}
    for r in sorted(made, key=lambda r: (r.symbol, r.time)):
        by.setdefault(r.symbol, []).append(r)
    series = {}
    for r in rows:
        series.setdefault(r[0], []).append(r)
    return by, series


@pytest.mark.parametrize("name", sorted(LOOPS))
def test_loops_over_bars_agree(got, name):
    by, series = got
    outputs = DEFINITIONS[name].outputs(P[name])
    for symbol, rows in series.items():
        for i, (want, row) in enumerate(zip(LOOPS[name]([r[2:] for r in rows], P[name]), by[symbol], strict=True)):
            for output, x in zip(outputs, want, strict=True):
                y = row[f"{name}_{output}"]
                assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(x))), (name, symbol, i, output, x, y)


#: Sums from the first bar on, and values that look back over valid bars only, do not come back to the series without gaps.
OWN_WAY = {"AccumulationDistributionLine", "WilliamsVariableAccumulationDistribution"} | (set(LOOPS) - {"KaufmanEfficiencyRatio", "BalanceOfMarketPower"})


@pytest.mark.parametrize("name", sorted(set(WINDOWED) - OWN_WAY))
def test_a_gap_leaves_no_value_until_it_has_left_the_window(got, name):
    """Bars before the gap are as without it, one of the bars from it on has no value, and once it is far behind all are as without it."""
    by, _ = got
    columns = [f"{name}_{o}" for o in DEFINITIONS[name].outputs(P[name])]
    same = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(a)))
    for c in columns:
        plain, gap = [r[c] for r in by["none"]], [r[c] for r in by["whole"]]
        assert same(plain[0], gap[0]) and same(plain[1], gap[1]), c
        assert all(x is None or same(x, y) for x, y in zip(gap, plain)), c  # a value is the right one or there is none
        assert same(plain[-1], gap[-1]) and plain[-1] is not None, c
        formed = next(i for i, x in enumerate(plain) if x is not None)
        if name not in ("LunarPhase", "SineWave"):
            assert formed > 150 or gap[150] is None or name == "Ichimoku", c
