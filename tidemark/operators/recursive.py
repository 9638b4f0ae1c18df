"""Indicators whose value depends on their own past: ordered folds over bars.

Each class takes resolved parameters; ``step`` takes one bar and gives a value, or
None, for each output. Bars come in order of time. ``RELOCATED`` classes give
(output, target index, value) events instead.
"""

from __future__ import annotations

import math
from collections import deque
from typing import NamedTuple

from ..functions.kernels import (
    Aroon, Directional, Extreme, Macd, PartialSma, Rsi, Sma, Smoothed, TrueRange, Value, Window,
    chained_ema, divide, ema, expanding_wilder, forming, minus, partial_ema, wilder,
)


class Bar(NamedTuple):
    i: int
    time: int
    open: Value
    high: Value
    low: Value
    close: Value
    volume: Value


RECURSIVE: dict[str, type] = {}
RELOCATED: dict[str, type] = {}


class Fold:
    """Registers its subclasses under their names.

    ``commit`` takes a final bar. ``preview`` gives the values for a bar that is still
    forming, and changes nothing: a copy of the fold, on which blocks preview, takes
    the step. Where a fold itself treats such a bar in another way, it asks ``forming``.
    A line that has had no value on a final bar has none on a forming one, but for
    folds whose values are ``standing``: those come from earlier bars.
    """

    forming = False
    standing = False
    seen: tuple[bool, ...] = ()

    def __init_subclass__(cls, relocated: bool = False, base: bool = False) -> None:
        if not base:
            (RELOCATED if relocated else RECURSIVE)[cls.__name__] = cls

    def __init__(self, p: dict) -> None:
        self.p = p
        self.start(**p)

    def start(self, **p) -> None:
        pass

    def step(self, b: Bar) -> tuple:
        raise NotImplementedError

    def commit(self, b: Bar) -> tuple:
        values = self.step(b)
        if not all(self.seen) or not self.seen:
            self.seen = tuple(v is not None or old for v, old in zip(values, self.seen or (False,) * len(values)))
        return values

    def preview(self, b: Bar) -> tuple:
        values = forming(self).step(b)
        return values if self.standing else tuple(v if f else None for v, f in zip(values, self.seen or (False,) * len(values)))


def middle(b: Bar) -> Value:
    return None if b.high is None or b.low is None else (b.high + b.low) / 2


def typical(b: Bar) -> Value:
    return None if None in (b.high, b.low, b.close) else (b.high + b.low + b.close) / 3


# Trend -----------------------------------------------------------------------


class _OneMean(Fold, base=True):
    make = staticmethod(ema)

    def start(self, length):
        self.mean = self.make(length)

    def step(self, b):
        return (self.mean.push(b.close),)


class ExponentialMovingAverage(_OneMean):
    pass


class SmoothedMovingAverage(_OneMean):
    make = staticmethod(wilder)


class WilderMovingAverage(_OneMean):
    make = staticmethod(wilder)


class _Cascade(Fold, base=True):
    def start(self, length):
        self.means = [chained_ema(length) for _ in self.shares]

    def step(self, b):
        x, total = b.close, 0.0
        for mean, share in zip(self.means, self.shares):
            x = mean.push(x)
            if x is None:
                return (None,)
            total += share * x
        return (total,)


class DoubleExponentialMovingAverage(_Cascade):
    shares = (2, -1)


class TripleExponentialMovingAverage(_Cascade):
    shares = (3, -3, 1)


class GuppyMultipleMovingAverage(Fold):
    def start(self):
        self.means = [ema(n) for n in (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)]

    def step(self, b):
        return tuple(m.push(b.close) for m in self.means)


class T3MovingAverage(Fold):
    """Six means in a row, each fed from the first bar on, mixed with Tillson's weights; nine bars more of warm-up."""

    def start(self, length, volumeFactor):
        v = volumeFactor
        self.first = length + 8
        self.means = [partial_ema(length) for _ in range(6)]
        self.shares = (1 + 3 * v + 3 * v**2 + v**3, -3 * v - 6 * v**2 - 3 * v**3, 3 * v**2 + 3 * v**3, -(v**3))

    def step(self, b):
        x, values = b.close, []
        for mean in self.means:
            x = mean.push(x)
            values.append(x)
        if b.i < self.first or x is None:
            return (None,)
        return (sum(s * y for s, y in zip(self.shares, values[2:])),)


class AdaptiveLaguerreFilter(Fold):
    def start(self, gamma):
        self.gamma, self.stages, self.formed = gamma, [0.0] * 4, False

    def step(self, b):
        if b.close is None:
            return (None,)
        x = b.close
        for k in range(4):
            x = self.stages[k] = x + self.gamma * (self.stages[k] - x)
        l0, l1, l2, l3 = self.stages
        value = (l0 + 2 * l1 + 2 * l2 + l3) / 6
        self.formed |= value >= b.close
        return (value if self.formed else None,)


class JurikMovingAverage(Fold):
    def start(self, length, phase):
        share = 0.45 * (length - 1)
        self.length, self.beta, self.formed = length, share / (share + 2), False
        self.tilt = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100 + 1.5

    def step(self, b):
        if b.close is None:
            return (None,)
        if not self.formed:
            self.a = self.b = b.close
            self.formed = b.i + 1 >= self.length
            return (b.close if self.formed else None,)
        self.a += self.beta * (b.close - self.a)
        move = self.beta * (self.a - self.b)
        self.b += move
        return (self.b + self.tilt * move,)


class KalmanFilter(Fold):
    def start(self, length, processNoise, measurementNoise):
        self.length, self.q, self.r = length, processNoise, measurementNoise
        self.value, self.spread, self.count = None, 1.0, 0

    def step(self, b):
        if b.close is None:
            return (None,)
        if self.value is None:
            self.value = b.close
        else:
            prior = self.spread + self.q
            gain = prior / (prior + self.r)
            self.value += gain * (b.close - self.value)
            self.spread = (1 - gain) * prior
        self.count += 1
        return (self.value if self.count >= self.length else None,)


class KaufmanAdaptiveMovingAverage(Fold):
    def start(self, length, fastSCPeriod, slowSCPeriod):
        self.n, self.window, self.value, self.dead = length, Window(length + 1), None, False
        self.fast, self.slow = 2 / (fastSCPeriod + 1), 2 / (slowSCPeriod + 1)

    def step(self, b):
        if self.forming:  # the path goes on from the window's front
            w = [*self.window.items, b.close]
            whole = self.window.full and None not in w
        else:
            self.window.push(b.close)
            w = list(self.window.items)
            whole = self.window.full and None not in w
        if self.value is None:
            self.dead |= b.close is None or (b.i >= self.n and not whole)
            if self.dead or b.i < self.n:
                return (None,)
            self.value = b.close
            return (self.value,)
        if not whole:
            return (None,)
        path = sum(abs(y - x) for x, y in zip(w, w[1:]))
        ratio = abs(w[-1] - w[0]) / path if path else 0.0
        self.value += (b.close - self.value) * (ratio * (self.fast - self.slow) + self.slow) ** 2
        return (self.value,)


class FractalAdaptiveMovingAverage(Fold):
    """Three ranges of the window, each over the same period, give a dimension and so the weight."""

    def start(self, length):
        self.window, self.period, self.value = Window(length), length // 3, None

    def step(self, b):
        if b.close is None:
            return (None,)
        self.window.push(b.close)
        if not self.window.full:
            return (None,)
        w, k = list(self.window.items), self.period
        a, m, z = ((max(x) - min(x)) / k for x in (w[:k], w[k : 2 * k], w[2 * k :]))
        if self.value is None:
            self.value = b.close
        if z > 0 and a + m > 0:
            dimension = min(2.0, max(1.0, (math.log(a + m) - math.log(z)) / math.log(2)))
        else:  # the logarithm of nothing: as far as it goes, or undefined
            dimension = 2.0 if a + m > 0 else 1.0
        self.value += math.exp(-4.6 * (dimension - 1)) * (b.close - self.value)
        return (self.value,)


class McGinleyDynamic(Fold):
    def start(self, length):
        self.n, self.seed, self.value = length, Smoothed(length, 0.0, gap="seed"), None

    def step(self, b):
        if self.seed.count < self.n and not self.seed.spoilt:
            self.value = self.seed.push(b.close)
            return (self.value,)
        if b.close is None or self.value is None:
            return (None,)
        if self.value == 0:
            self.value = b.close
        else:
            scale = 0.6 * self.n * (b.close / self.value) ** 4
            if scale == 0 or not math.isfinite(scale):
                return (None,)
            value = self.value + (b.close - self.value) / scale
            if not math.isfinite(value):
                return (None,)
            self.value = value
        return (self.value,)


class OptimalTracking(Fold):
    decay = math.exp(-0.25)

    def start(self, length):
        self.n, self.count, self.center, self.reach, self.drift, self.ratio, self.value = length, 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def step(self, b):
        if b.high is None or b.low is None:
            return (None,)
        center, reach = (b.high + b.low) / 2, (b.high - b.low) / 2
        self.count += 1
        if self.count < self.n:
            self.center, self.reach, self.value = center, reach, center
            return (None,)
        self.drift = (1 - self.decay) * (center - self.center) + self.decay * self.drift
        self.reach = (1 - self.decay) * reach + self.decay * self.reach
        self.center = center
        if self.reach:
            self.ratio = abs(self.drift / self.reach)
        s = self.ratio**2
        weight = (math.sqrt(s * s + 16 * s) - s) / 8
        self.value = weight * center + (1 - weight) * self.value
        return (self.value,)


class VariableMovingAverage(Fold):
    def start(self, length, volatilityIndex):
        self.n, self.k = length, volatilityIndex
        self.closes, self.prices, self.value = Window(length), Window(length), None

    def step(self, b):
        if b.close is None:
            return (None,)
        if self.value is None:
            self.value = b.close
            self.prices.push(b.close)
            return (None,)
        self.closes.push(b.close)
        if not self.closes.full:
            return (None,)
        w = self.closes.items
        mean = sum(w) / self.n
        deviation = 0.0 if max(w) == min(w) else math.sqrt(sum((x - mean) ** 2 for x in w) / self.n)
        price = sum(self.prices.items) / len(self.prices.items)
        share = abs(deviation / price) if price else 0.0
        self.value += (b.close - self.value) * 2 / (self.n * (1 + self.k * share) + 1)
        self.prices.push(b.close)
        return (self.value,)


class Vidya(Fold):
    def start(self, length):
        self.n, self.before, self.moves, self.seed = length, None, Window(length), Smoothed(length, 0.0)

    def step(self, b):
        if b.close is None:
            return (None,)
        before, self.before = self.before, b.close
        if before is None:
            return (None,)
        self.moves.push(b.close - before)
        if not self.moves.full:
            return (None,)
        if not self.seed.formed:
            return (self.seed.push(b.close),)
        path = sum(map(abs, self.moves.items))
        share = abs(sum(self.moves.items)) / path if path else 0.0
        self.seed.value += (b.close - self.seed.value) * share * 2 / (self.n + 1)
        return (self.seed.value,)


class ZeroLagExponentialMovingAverage(Fold):
    """Starts from zero, not from a seed. A gap takes a place, and leaves no value where it lags onto a bar."""

    def start(self, length):
        self.n, self.window, self.value = length, Window(length), 0.0

    def step(self, b):
        self.window.push(b.close)
        if not self.window.full:
            return (None,)
        weight = 2 / (self.n + 1)
        earlier = self.window.items[(self.n - 1) // 2]
        if b.close is None or earlier is None:
            return (None,)
        self.value = weight * (2 * b.close - earlier) + (1 - weight) * self.value
        return (self.value,)


class AroonOscillator(Fold):
    def start(self, length):
        self.ages = Aroon(length)

    def step(self, b):
        return (minus(*self.ages.push(b.high, b.low)),)


class AverageDirectionalIndex(Fold):
    def start(self, length):
        self.n, self.moves, self.mean = length, Directional(length), expanding_wilder(length)

    def step(self, b):
        found = self.moves.push(b.high, b.low, b.close)
        if found is None or b.i < self.n + 1:
            return (None, None)
        mean = self.mean.push(found[2])
        return (found[2], mean if b.i >= 2 * self.n else None)


class DirectionalIndex(Fold):
    def start(self, length):
        self.n, self.moves = length, Directional(length)

    def step(self, b):
        found = self.moves.push(b.high, b.low, b.close)
        return (None, None, None) if found is None or b.i < self.n + 1 else found


class NickRypockTrailingReverse(Fold):
    def start(self, length, multiple):
        self.n, self.scale = length, max(1.0, multiple) / 1000
        self.k, self.value, self.trend, self.count = None, 0.0, 0, 0

    def step(self, b):
        c = b.close
        if c is None:
            return (None,)
        self.count += 1
        if self.k is None:
            self.k = self.high = self.low = c
        self.k = (self.k + (c - self.k) / self.n) * self.scale
        trend = self.trend
        if trend >= 0:
            self.high = max(self.high, c)
            self.value = self.high - self.k
            self._turn(-1 if c <= self.value else 1, c)
        if trend <= 0:
            self.low = min(self.low, c)
            self.value = self.low + self.k
            self._turn(1 if c >= self.value else -1, c, rising=True)
        return (self.value if self.count >= self.n else None,)

    def _turn(self, to: int, c: float, rising: bool = False) -> None:
        self.trend = to
        if not rising and to < 0:
            self.low, self.value = c, c + self.k
        elif rising and to > 0:
            self.high, self.value = c, c - self.k


class SuperTrend(Fold):
    def start(self, length, multiplier):
        self.n, self.k = length, multiplier
        self.reach, self.mean = TrueRange(), expanding_wilder(length)
        self.upper = self.lower = self.before = None
        self.trend = 0

    def step(self, b):
        mean = self.mean.push(self.reach.push(b.high, b.low, b.close))
        if mean is None:
            return (None,)
        before, self.before = self.before, b.close
        if b.i < self.n - 1:
            return (None,)
        center = (b.high + b.low) / 2
        upper, lower = center + self.k * mean, center - self.k * mean
        if self.upper is None or upper < self.upper or before > self.upper:
            self.upper = upper
        if self.lower is None or lower > self.lower or before < self.lower:
            self.lower = lower
        if self.trend == 0:
            self.trend = 1 if b.close >= center else -1
        elif self.trend > 0 and b.close <= self.lower:
            self.trend = -1
        elif self.trend < 0 and b.close >= self.upper:
            self.trend = 1
        return (self.lower if self.trend > 0 else self.upper,)


class ParabolicSar(Fold):
    """Stop and reverse over the last three bars, the first of all counted twice.

    The stop may turn when it is moved on, and again when it is crossed.
    """

    def start(self, acceleration, accelerationStep, accelerationMax):
        self.first, self.more, self.most = acceleration, accelerationStep, accelerationMax
        self.tail: deque = deque(maxlen=3)
        self.long, self.extreme, self.factor, self.last = False, 0.0, acceleration, None

    def step(self, b):
        if b.high is None or b.low is None:
            return (None,)
        for _ in range(1 if self.tail else 2):
            self.tail.append((b.high, b.low))
        if len(self.tail) < 3:
            return (None,)
        self.last = self._begin() if self.last is None else self._next()
        return (self.last or None,)

    def _begin(self) -> float:
        self.long = self.tail[-1][0] > self.tail[-2][0]
        top, bottom = max(x[0] for x in self.tail), min(x[1] for x in self.tail)
        self.extreme = top if self.long else bottom
        return self.extreme + (-1 if self.long else 1) * (top - bottom) * self.first

    def _turn(self) -> float:
        """To the other side; the stop is the extreme so far."""
        stop, self.long, self.factor = self.extreme, not self.long, self.first
        self.extreme = self.tail[-1][0 if self.long else 1]
        return stop

    def _next(self) -> float:
        (high2, low2), (high1, low1), (high, low) = self.tail
        stop = self.last + self.factor * (self.extreme - self.last)
        if self.long:
            stop = min(stop, low, low1)
            kept = low > stop
        else:
            stop = max(stop, high, high1)
            kept = high < stop
        if not kept:
            stop = self._turn()
        stop = min(stop, low1, low2) if self.long else max(stop, high1, high2)
        if min(low, low1) < stop if self.long else max(high, high1) > stop:
            return self._turn()
        if high > self.extreme if self.long else low < self.extreme:
            self.extreme = high if self.long else low
            self.factor = min(self.most, self.factor + self.more)
        return stop


class Alligator(Fold):
    """Three smoothed means of the middle price, as they stand on each bar: drawn ``shift`` bars after they were computed."""

    def start(self, jawLength, jawShift, teethLength, teethShift, lipsLength, lipsShift):
        self.lines = [(Smoothed(n, 1 / n), Window(s + 1)) for n, s in ((jawLength, jawShift), (teethLength, teethShift), (lipsLength, lipsShift))]
        self.standing = min(jawShift, teethShift, lipsShift) > 0

    def step(self, b):
        out, x = [], middle(b)
        for mean, held in self.lines:
            held.push(mean.push(x))
            out.append(held.items[0] if held.full else None)
        return tuple(out)


class Aroon_(Fold, base=True):
    def start(self, length):
        self.ages = Aroon(length)

    def step(self, b):
        return self.ages.push(b.high, b.low)


RECURSIVE["Aroon"] = Aroon_

# Momentum --------------------------------------------------------------------


class CompositeMomentum(Fold):
    def start(self, shortRocLength, longRocLength, rsiLength, emaFastLength, emaSlowLength, smaLength):
        self.past = [Window(shortRocLength + 1), Window(longRocLength + 1)]
        self.rsi, self.rsi_from = Rsi(rsiLength), rsiLength
        self.fast, self.slow, self.mean = chained_ema(emaFastLength), chained_ema(emaSlowLength), PartialSma(smaLength)

    def step(self, b):
        changes = []
        for w in self.past:
            if not self.forming:
                w.push(b.close)
            changes.append(divide(minus(b.close, w.items[0]), w.items[0]) if w.full else None)
        rsi, fast, slow = self.rsi.push(b.close), self.fast.push(b.close), self.slow.push(b.close)
        if None in (*changes, rsi, fast, slow) or b.i < self.rsi_from:
            return (None, None)
        value = 100 * (sum(changes) + (rsi - 50) / 50 + divide(fast - slow, slow, 0.0)) / 4
        mean = self.mean.push(value)
        return (value, mean if self.mean.formed else None)


class ConnorsRSI(Fold):
    def start(self, rsiPeriod, streakRSIPeriod, rocRSIPeriod):
        self.first, self.n = max(rsiPeriod, streakRSIPeriod, rocRSIPeriod), rocRSIPeriod
        self.rsis = [Rsi(n, array=True) for n in (rsiPeriod, streakRSIPeriod, rocRSIPeriod)]
        self.past, self.before, self.streak = Window(rocRSIPeriod + 1), None, 0

    def step(self, b):
        c, streak, change = b.close, None, None
        if c is not None:
            side = 1 if self.before is None else (c > self.before) - (c < self.before)
            streak = side + self.streak if side * self.streak > 0 else side
            base = self.past.items[1 if self.past.full and not self.forming else 0] if self.past.items else c
            change = divide(100 * (c - base), base) if base is not None else None
            self.before, self.streak = c, streak
        values = [r.push(x) for r, x in zip(self.rsis, (c, None if streak is None else float(streak), change))]
        self.past.push(c)
        if b.i < self.first or None in values:
            return (None,) * 4
        return (*values, sum(values) / 3)


class ConstanceBrownCompositeIndex(Fold):
    def start(self, rsiLength, rocLength, shortRsiLength, momentumLength, fastSmaLength, slowSmaLength):
        self.long, self.short = Rsi(rsiLength, array=True), Rsi(shortRsiLength, array=True)
        self.past, self.mean, self.roc = Window(rocLength + 1), PartialSma(momentumLength), rocLength
        self.fast, self.slow = Sma(fastSmaLength), Sma(slowSmaLength)
        self.first = max(rsiLength, shortRsiLength, rocLength + 1, momentumLength)

    def step(self, b):
        rsi, short = self.long.push(b.close), self.short.push(b.close)
        at = len(self.past.items) - self.roc - self.forming
        move = minus(rsi, self.past.items[at]) if at >= 0 else None
        self.past.push(rsi)
        mean = self.mean.push(short)
        value = (move or 0.0) + (mean or 0.0) if b.i >= self.first else None
        fast, slow = self.fast.push(value), self.slow.push(value)
        return (value, fast, slow)


class DynamicZonesRSI(Fold):
    def start(self, length, oversoldLevel, overboughtLevel):
        self.rsi, self.top, self.bottom = Rsi(length), Extreme(length, 1), Extreme(length, -1)
        self.low, self.high = oversoldLevel / 100, overboughtLevel / 100

    def step(self, b):
        rsi = self.rsi.push(b.close)
        if rsi is None:
            return (None,)
        top, bottom = self.top.push(rsi), self.bottom.push(rsi)
        if top is None or bottom is None:
            return (None,)
        low, high = bottom + (top - bottom) * self.low, bottom + (top - bottom) * self.high
        return (0.0 if rsi <= low else 100.0 if rsi >= high else 100 * (rsi - low) / (high - low),)


class ElderImpulseSystem(Fold):
    grain = 2.0**-52 * 128

    def start(self, emaLength, shortMaLength, longMaLength):
        self.mean, self.macd = ema(emaLength), Macd(shortMaLength, longMaLength)
        self.before: tuple[Value, Value] = (None, None)

    def step(self, b):
        now = (self.mean.push(b.close), self.macd.push(b.close)[0])
        before, self.before = self.before, now
        if None in (*now, *before):
            return (None,)
        sides = {self._side(x, y) for x, y in zip(before, now)}
        return (float(sides.pop()) if len(sides) == 1 else 0.0,)

    def _side(self, x: float, y: float) -> int:
        grain = self.grain * max(1.0, abs(x), abs(y))
        return (y - x > grain) - (x - y > grain)


class GatorOscillator(Fold):
    """Gaps of the three lines on each bar. A line counts from its length's bar on, with what its seed has by then.

    A forming bar shows what the bar before it showed.
    """

    def start(self, jawLength, jawShift, teethLength, teethShift, lipsLength, lipsShift):
        sizes = (jawLength, jawShift), (teethLength, teethShift), (lipsLength, lipsShift)
        self.lines = [(n, Smoothed(n, 1 / n, warm="part"), Window(s + 1)) for n, s in sizes]
        self.shown = (None, None)

    def step(self, b):
        if self.forming:
            return self.shown
        x, now = middle(b), []
        for n, mean, held in self.lines:
            value = mean.push(x)
            held.push(value if b.i >= n - 1 else None)
            now.append(held.items[0] if held.full else None)
        jaw, teeth, lips = now
        upper, lower = minus(jaw, lips), minus(lips, teeth)
        self.shown = (None if upper is None else abs(upper), None if lower is None else -abs(lower))
        return self.shown


class KasePeakOscillator(Fold):
    def start(self, shortPeriod, longPeriod):
        self.first, self.second = 8 + shortPeriod, 8 + longPeriod
        self.reach, self.mean = TrueRange(), expanding_wilder(10)
        self.peaks, self.valleys, self.before = Window(2), Window(2), 0.0

    def step(self, b):
        mean = self.mean.push(self.reach.push(b.high, b.low, b.close))
        if b.i < 9 + self.forming or mean is None:
            return (None, None)
        peak, valley = b.high, b.low
        if self.before and b.close > self.before:
            peak, valley = max(peak, self.before + mean), max(valley, self.before - mean / 2)
        elif self.before and b.close < self.before:
            peak, valley = min(peak, self.before + mean / 2), min(valley, self.before - mean)
        self.before = b.close
        peaks, valleys = [*self.peaks.items, peak], [*self.valleys.items, valley]
        if not self.forming:  # a forming bar comes on top of the two
            self.peaks.push(peak)
            self.valleys.push(valley)
            peaks, valleys = self.peaks.items, self.valleys.items
        low, old_low = min(valleys), valleys[0]
        short = divide(100 * (b.close - low), max(peaks) - low, 0.0)
        long = divide(100 * (b.close - old_low), peaks[0] - old_low, 0.0)
        return (short if b.i >= self.first else None, long if b.i >= self.second else None)


class LaguerreRSI(Fold):
    def start(self, gamma):
        self.gamma, self.stages, self.up, self.down = gamma, [0.0] * 4, 0.0, 0.0

    def step(self, b):
        if b.close is None:
            return (None,)
        g, old = self.gamma, self.stages
        new = [(1 - g) * b.close + g * old[0]]
        for k in range(1, 4):
            new.append(old[k - 1] + g * (old[k] - new[k - 1]))
        self.stages = new
        steps = [new[k] - new[k + 1] for k in range(3)]
        self.up = (1 - g) * sum(s for s in steps if s > 0) + g * self.up
        self.down = (1 - g) * sum(-s for s in steps if s < 0) + g * self.down
        return (divide(100 * self.up, self.up + self.down, 50.0),)


class MomentumOfMovingAverage(Fold):
    """The mean goes into the window it was taken from; ``momentumPeriod`` changes nothing."""

    def start(self, length, momentumPeriod):
        self.n, self.window = length, Window(length)

    def step(self, b):
        if b.close is None:
            return (None,)
        self.window.push(b.close)
        if not self.window.full:
            return (None,)
        mean = sum(self.window.items) / self.n
        self.window.push(mean)
        first = self.window.items[0]
        return (divide(100 * (mean - first), first),)


class MovingAverageConvergenceDivergence(Fold):
    def start(self, shortMaLength, longMaLength):
        self.macd = Macd(shortMaLength, longMaLength)

    def step(self, b):
        return self.macd.push(b.close)[:1]


class MovingAverageConvergenceDivergenceHistogram(Fold):
    def start(self, shortMaLength, longMaLength, signalMaLength):
        self.macd = Macd(shortMaLength, longMaLength, signalMaLength)

    def step(self, b):
        return self.macd.push(b.close)


class MovingAverageConvergenceDivergenceSignal(MovingAverageConvergenceDivergenceHistogram):
    def step(self, b):
        return self.macd.push(b.close)[:2]


class PercentagePriceOscillator(Fold):
    def start(self, shortPeriod, longPeriod):
        self.ppo = Macd(shortPeriod, longPeriod, relative=True)

    def step(self, b):
        return self.ppo.push(b.close)[:1]


class PercentagePriceOscillatorHistogram(Fold):
    def start(self, shortPeriod, longPeriod, signalMaLength):
        self.ppo = Macd(shortPeriod, longPeriod, signalMaLength, relative=True)

    def step(self, b):
        return self.ppo.push(b.close)


class PercentagePriceOscillatorSignal(PercentagePriceOscillatorHistogram):
    def step(self, b):
        return self.ppo.push(b.close)[:2]


class PsychologicalLine(Fold):
    """A leaving close takes one off the count if it is under the latest close before this bar."""

    def start(self, length):
        self.window, self.ups = Window(length), 0

    def step(self, b):
        if b.close is None:
            return (None,)
        w = self.window.items
        if self.window.full and w[0] < w[-1] and not self.forming:
            self.ups -= 1
        if w and b.close > w[-1]:
            self.ups += 1
        self.window.push(b.close)
        return (self.ups / self.window.n if self.window.full else None,)


class RelativeStrengthIndex(Fold):
    def start(self, length):
        self.rsi = Rsi(length)

    def step(self, b):
        return (self.rsi.push(b.close),)


class Trix(Fold):
    def start(self, length, rocLength):
        self.means, self.past = [chained_ema(length) for _ in range(3)], Window(rocLength + 1)

    def step(self, b):
        x = b.close
        for mean in self.means:
            x = mean.push(x)
        if x is None:
            return (None,)
        if not self.forming:
            self.past.push(x)
        return (divide(1000 * (x - self.past.items[0]), self.past.items[0]) if self.past.full else None,)


class TrueStrengthIndex(Fold):
    def start(self, firstLength, secondLength, signalLength):
        self.first = [partial_ema(firstLength), partial_ema(firstLength)]
        self.second = [partial_ema(secondLength), partial_ema(secondLength)]
        self.signal, self.before, self.started = partial_ema(signalLength), None, False

    def step(self, b):
        before, self.before = self.before, b.close
        move = minus(b.close, before)
        if move is None:
            return (None, None)
        above, below = (s.push(f.push(x)) for f, s, x in zip(self.first, self.second, (move, abs(move))))
        if not self.second[0].formed:
            return (None, None)
        value = divide(100 * above, below, 0.0)
        mean = self.signal.push(value)
        return (value, mean if self.signal.formed else None)


class WaveTrendOscillator(Fold):
    def start(self, esaPeriod, dPeriod, averagePeriod):
        self.mean, self.spread, self.average = chained_ema(esaPeriod), chained_ema(dPeriod), PartialSma(averagePeriod)

    def step(self, b):
        x = typical(b)
        mean = self.mean.push(x)
        if mean is None:
            return (None, None)
        spread = self.spread.push(abs(x - mean))
        if spread is None or spread <= abs(x) * 1e-12:
            return (None, None)
        value = (x - mean) / (0.015 * spread)
        return (value, self.average.push(value))


# Volatility ------------------------------------------------------------------


class AdaptivePriceZone(Fold):
    def start(self, period, bandPercentage):
        self.n, self.k, self.mean, self.window = period, bandPercentage, ema(period), Window(period)

    def step(self, b):
        mean = self.mean.push(b.close)
        self.window.push(b.close)
        w = self.window.items
        if mean is None or not self.window.full or None in w:
            return (None,) * 3
        center = sum(w) / self.n
        spread = 0.0 if max(w) == min(w) else math.sqrt(sum((x - center) ** 2 for x in w) / self.n)
        return (mean, mean + self.k * spread, mean - self.k * spread)


class AverageTrueRange(Fold):
    def start(self, length):
        self.reach, self.mean = TrueRange(), wilder(length)

    def step(self, b):
        return (self.mean.push(self.reach.push(b.high, b.low, b.close)),)


class ChaikinVolatility(Fold):
    def start(self, emaLength, rocLength):
        self.mean, self.past = chained_ema(emaLength), Window(rocLength + 1)

    def step(self, b):
        mean = self.mean.push(minus(b.high, b.low))
        if mean is None:
            return (None,)
        if not self.forming:
            self.past.push(mean)
        return (divide(100 * (mean - self.past.items[0]), self.past.items[0]) if self.past.full else None,)


class KeltnerChannels(Fold):
    def start(self, length, multiplier):
        self.mean, self.reach, self.spread, self.k = chained_ema(length), TrueRange(), expanding_wilder(length), multiplier

    def step(self, b):
        mean, spread = self.mean.push(b.close), self.spread.push(self.reach.push(b.high, b.low, b.close))
        if mean is None or spread is None:
            return (None,) * 3
        return (mean + self.k * spread, mean, mean - self.k * spread)


class MassIndex(Fold):
    def start(self, length, emaLength):
        self.n, self.m = length, emaLength
        self.single, self.double, self.window = partial_ema(emaLength), partial_ema(emaLength), Window(length)

    def step(self, b):
        reach = minus(b.high, b.low)
        if reach is None:
            self.single, self.double = partial_ema(self.m), partial_ema(self.m)
            return (None,)
        single = self.single.push(reach)
        double = self.double.push(single)
        if not self.double.formed or not double:
            return (None,)
        self.window.push(single / double)
        return (sum(self.window.items) if self.window.full else None,)


# Volume ----------------------------------------------------------------------


class ApprovalFlowIndex(Fold):
    """The close that others are held against stands still once the line is formed."""

    def start(self, length):
        self.n, self.count, self.up, self.down, self.base = length, 0, 0.0, 0.0, 0.0

    def step(self, b):
        if b.close is None:
            return (None,)
        if not self.base:
            self.base = b.close
            return (None,)
        volume = b.volume or 0.0
        self.up += volume if b.close > self.base else 0.0
        self.down += volume if b.close < self.base else 0.0
        self.count += 1
        if self.count < self.n:
            self.base = b.close
            return (None,)
        return (divide(100 * (self.up - self.down), self.up + self.down),)


class DemandIndex(Fold):
    """Both anchors move on only where price and volume have both changed."""

    def start(self, length):
        self.mean, self.close, self.volume, self.value = Sma(length), 0.0, 0.0, None

    def step(self, b):
        if b.close is None or b.volume is None:
            return (None,)
        if not self.close or not self.volume:
            self.close, self.volume = b.close, b.volume
            return (None,)
        move, flow = b.close - self.close, b.volume - self.volume
        if not move or not flow:
            return (self.value,)
        self.close, self.volume = b.close, b.volume
        x, y = math.log(abs(move)), math.log(abs(flow))
        raw = divide(x * y, x - y, 0.0) * (1 if move > 0 else -1)
        value = self.mean.push(raw)
        if value is not None:
            self.value = value
        return (value,)


class EaseOfMovement(Fold):
    """The bar that moves are measured from stands still once the mean is there."""

    def start(self, length):
        self.mean, self.high, self.low = Sma(length), 0.0, 0.0

    def step(self, b):
        if None in (b.high, b.low, b.volume):
            return (None,)
        value, reach = None, b.high - b.low
        if self.high and self.low and reach and b.volume:
            move = ((b.high + b.low) / 2 - (self.high + self.low) / 2) * reach / b.volume
            if self.forming:  # on top of a full window
                value = (sum(self.mean.items) + move) / self.mean.n if self.mean.full else None
            else:
                value = self.mean.push(move)
        if value is None:
            self.high, self.low = b.high, b.low
        return (value,)


class ForceIndex(Fold):
    def start(self, length):
        self.mean, self.before = chained_ema(length), None

    def step(self, b):
        before, self.before = self.before, b.close
        if not before:
            return (None,)
        move = minus(b.close, before)
        return (self.mean.push(None if move is None or b.volume is None else move * b.volume),)


class ElderForceIndex(Fold):
    def start(self, length):
        self.mean, self.before = chained_ema(length), None

    def step(self, b):
        if b.close is None:
            return (None,)
        before, self.before = self.before, b.close
        return (self.mean.push((b.volume or 0.0) * (b.close - before)) if before else None,)


class KlingerVolumeOscillator(Fold):
    def start(self, shortPeriod, longPeriod):
        self.macd, self.before = (chained_ema(shortPeriod), chained_ema(longPeriod)), 0.0

    def step(self, b):
        x, flow = typical(b), None
        if x is not None and b.volume is not None:
            flow = b.volume if x > self.before else -b.volume
            self.before = x
        short, long = (m.push(flow) for m in self.macd)
        return (short, long, minus(short, long))


class PercentageVolumeOscillator(Fold):
    def start(self, shortPeriod, longPeriod):
        self.short, self.long = chained_ema(shortPeriod), chained_ema(longPeriod)

    def step(self, b):
        short, long = self.short.push(b.volume), self.long.push(b.volume)
        return (short, long, divide(100 * minus(short, long), long, 0.0) if None not in (short, long) else None)


class _VolumeIndex(Fold, base=True):
    def start(self):
        self.value, self.close, self.volume = 1000.0, 0.0, 0.0

    def step(self, b):
        if b.close is not None and b.volume is not None:
            if self.close and self.volume and b.volume and (b.volume - self.volume) * self.side > 0:
                self.value += self.value * (b.close - self.close) / self.close
            self.close, self.volume = b.close, b.volume
        return (self.value,)


class NegativeVolumeIndex(_VolumeIndex):
    side = -1


class PositiveVolumeIndex(_VolumeIndex):
    side = 1


class TwiggsMoneyFlow(Fold):
    def start(self, length):
        self.flow, self.volume, self.last = chained_ema(length), chained_ema(length), 0.0

    def step(self, b):
        x = typical(b)
        if x is None or b.volume is None:
            return (None,)
        reach = b.high - b.low
        if reach:
            self.last = b.volume * (2 * x - b.high - b.low) / reach
        return (divide(self.flow.push(self.last), self.volume.push(b.volume)) or None,)


# Market strength and cycles --------------------------------------------------


class BearPower(Fold):
    def start(self, length):
        self.mean = ema(length)

    def step(self, b):
        return (minus(b.low, self.mean.push(b.close)),)


class BullPower(BearPower):
    def step(self, b):
        return (minus(b.high, self.mean.push(b.close)),)


class ElderRay(BearPower):
    def step(self, b):
        mean = self.mean.push(b.close)
        return (minus(b.high, mean), minus(b.low, mean))


class McClellanOscillator(Fold):
    def start(self, ema19Length, ema39Length):
        self.short, self.long = ema(ema19Length), ema(ema39Length)

    def step(self, b):
        return (minus(self.short.push(b.close), self.long.push(b.close)),)


class EhlersFisherTransform(Fold):
    def start(self, length):
        self.top, self.bottom, self.value, self.main = Extreme(length, 1), Extreme(length, -1), 0.0, 0.0

    def step(self, b):
        x = middle(b)
        if self.forming:  # within the range of the final bars
            top, bottom = (side.partial if side.full else None for side in (self.top, self.bottom))
        else:
            top, bottom = self.top.push(b.high), self.bottom.push(b.low)
        if x is None or top is None or bottom is None:
            return (None, None)
        place = divide(x - bottom, top - bottom, 0.5)
        self.value = min(0.999, max(-0.999, 0.33 * (place - 0.5) + 0.67 * self.value))
        before, self.main = self.main, 0.5 * math.log((1 + self.value) / (1 - self.value))
        return (self.main, before)


class SchaffTrendCycle(Fold):
    def start(self, length, shortMaLength, longMaLength, stochasticKLength, signalMaLength):
        self.macd = Macd(shortMaLength, longMaLength, signalMaLength)
        self.top, self.bottom = Extreme(length, 1), Extreme(length, -1)
        self.k_top, self.k_bottom = Extreme(stochasticKLength, 1), Extreme(stochasticKLength, -1)
        self.mean, self.last = chained_ema(length), 0.0

    def step(self, b):
        if b.close is not None:
            self.top.push(b.close)
            self.bottom.push(b.close)
        gap = self.macd.push(b.close)[2]
        if gap is None or self.top.partial is None:
            return (None,)
        reach = self.top.partial - self.bottom.partial
        value = self.last
        if reach:
            raw = (gap - self.bottom.partial) / reach
            self.k_top.push(raw)
            self.k_bottom.push(raw)
            ends = [x for x in (raw, self.k_top.partial, self.k_bottom.partial) if x is not None]
            value = divide(100 * (raw - min(ends)), max(ends) - min(ends), 0.0)
        if not self.k_top.full:
            return (None,)
        self.last = value
        return (self.mean.push(value),)


# Events placed on earlier bars -----------------------------------------------


class _Turns(Fold, base=True):
    """Percent reversals of one price; ``sides`` are the legs (1 up, -1 down) whose ends count.

    An end is placed where the leg began to be followed, ``back`` bars ago.
    """

    def start(self, deviation):
        self.share, self.before, self.extreme, self.up, self.back, self.dead = deviation, None, None, None, 0, False

    def step(self, b):
        x = getattr(b, self.field)
        if self.dead or x is None:
            self.dead |= self.before is None
            return ()
        before, self.before = self.before, x
        if before is None:
            return ()
        if self.extreme is None:
            self.extreme, self.up = x, x >= before
        side = 1 if self.up else -1
        risen = (x - self.extreme) * side > 0
        if risen:
            self.extreme = x
        if risen or (self.extreme - x) * side < self.extreme * self.share:
            self.back += 1
            return ()
        event = ()
        if side in self.sides:
            placed = b.i if len(self.sides) == 2 and self.extreme == 0 else b.i - self.back
            event = (("value", placed, self.extreme),)
        self.up, self.extreme, self.back = not self.up, x, 1
        return event


class ZigZag(_Turns, relocated=True):
    field, sides = "close", (1, -1)


class Peak(_Turns, relocated=True):
    field, sides = "high", (1,)


class Trough(_Turns, relocated=True):
    field, sides = "low", (-1,)


class Fractals(Fold, relocated=True):
    """The middle bar of a window that rises strictly to it and falls strictly after; hits of a side are a window apart."""

    def start(self, length):
        self.n, self.highs, self.lows, self.since = length, Window(length), Window(length), [0, 0]

    def step(self, b):
        self.highs.push(b.high)
        self.lows.push(b.low)
        events = []
        for k, (name, window, sign) in enumerate((("up", self.highs, 1), ("down", self.lows, -1))):
            self.since[k] += 1
            w, half = list(window.items), self.n // 2
            if not window.full or None in w or self.since[k] < self.n:
                continue
            rises = [(y - x) * sign > 0 for x, y in zip(w, w[1:])]
            falls = [(x - y) * sign > 0 for x, y in zip(w, w[1:])]
            if all(rises[:half]) and all(falls[half:]):
                events.append((name, b.i - half, w[half]))
                self.since[k] = 0
        return tuple(events)
