"""Building blocks of ordered folds.

A block takes one value per bar through ``push`` and gives its value after that
bar or None. ``formed`` tells whether its warm-up is over. All state is in plain
attributes, so that blocks can be pickled into a stream's state.

``preview`` gives the value for a bar that is still forming and changes nothing. It
is what a push would give only where a block says no more of it: means and extrema
that read the window of final bars as it stands differ.
"""

from __future__ import annotations

import pickle
from collections import deque

Value = float | None


def divide(a: Value, b: Value, otherwise: Value = None) -> Value:
    if a is None or b is None:
        return None
    return a / b if b else otherwise


def minus(a: Value, b: Value) -> Value:
    return None if a is None or b is None else a - b


class Kernel:
    """A block. On a copy that is ``forming``, a push is a preview, so that folds of blocks are written once."""

    forming = False

    def push(self, *x):
        return self.preview(*x) if self.forming else self.take(*x)

    def take(self, *x):
        raise NotImplementedError

    def preview(self, *x):
        return forming(self).take(*x)


def forming(block):
    """A copy of a block, or of what is made of blocks, all of which preview."""
    made = pickle.loads(pickle.dumps(block))
    _mark(made)
    return made


def _mark(x) -> None:
    if isinstance(x, (list, tuple)):
        for y in x:
            _mark(y)
    elif hasattr(x, "forming"):
        x.forming = True
        for y in vars(x).values():
            _mark(y)


class Window:
    """The last n values; ``full`` once there are n."""

    def __init__(self, n: int) -> None:
        self.n, self.items = n, deque(maxlen=n)

    def push(self, x: Value) -> None:
        self.items.append(x)

    @property
    def full(self) -> bool:
        return len(self.items) == self.n


class Extreme(Kernel, Window):
    """Highest (sign 1) or lowest (sign -1) of the last n; a missing value empties the result while it is in the window.

    A forming value comes on top of the n of a full window.
    """

    def __init__(self, n: int, sign: int) -> None:
        Window.__init__(self, n)
        self.sign = sign

    @property
    def partial(self) -> Value:
        if not self.items or None in self.items:
            return None
        return max(self.items) if self.sign > 0 else min(self.items)

    def take(self, x: Value) -> Value:
        Window.push(self, x)
        return self.partial if self.full else None

    def preview(self, x: Value) -> Value:
        if x is None or not self.full or self.partial is None:
            return None
        return max(x, self.partial) if self.sign > 0 else min(x, self.partial)


class Sma(Kernel, Window):
    """Mean of the last n; a missing value takes a place. A forming value takes that of the oldest."""

    def take(self, x: Value) -> Value:
        Window.push(self, x)
        return sum(self.items) / self.n if self.full and None not in self.items else None

    def preview(self, x: Value) -> Value:
        held = [*self.items][1:]
        return (sum(held) + x) / self.n if self.full and x is not None and None not in held else None

    @property
    def formed(self) -> bool:
        return self.full


class PartialSma(Kernel, Window):
    """Sum of what is there over the whole length; missing values are skipped. A forming value takes the oldest one's place, full or not."""

    def take(self, x: Value) -> Value:
        if x is None:
            return None
        Window.push(self, x)
        return sum(self.items) / self.n

    def preview(self, x: Value) -> Value:
        return None if x is None else (sum([*self.items][1:]) + x) / self.n

    @property
    def formed(self) -> bool:
        return self.full


class Smoothed(Kernel):
    """value += (x - value) * weight, from the mean of the first n values.

    ``warm``: what is given before that: nothing, the sum over n ("part") or the
    mean so far ("mean"). ``gap``: whether a missing value is skipped ("skip"),
    spoils only the seed ("seed"), or spoils everything after it ("all"). A value that
    forms in the seed takes the place of the oldest there where a sum over n is given.
    """

    def __init__(self, n: int, weight: float, warm: str = "none", gap: str = "skip") -> None:
        self.n, self.weight, self.warm, self.gap = n, weight, warm, gap
        self.count, self.total, self.value, self.spoilt, self.oldest = 0, 0.0, None, False, 0.0

    @property
    def formed(self) -> bool:
        return self.count >= self.n and not self.spoilt

    def preview(self, x: Value) -> Value:
        if x is None or self.spoilt:
            return None
        if self.count >= self.n:
            return self.value + (x - self.value) * self.weight
        if self.warm == "mean":
            return (self.total + x) / (self.count + 1)
        return (self.total - self.oldest + x) / self.n if self.warm == "part" else None

    def take(self, x: Value) -> Value:
        if x is None:
            if self.gap == "all" or (self.gap == "seed" and self.count < self.n):
                self.spoilt = True
            return None
        if self.spoilt:
            return None
        if self.count < self.n:
            if not self.count:
                self.oldest = x
            self.count += 1
            self.total += x
            if self.count == self.n:
                self.value = self.total / self.n
                return self.value
            if self.warm == "none":
                return None
            return self.total / (self.n if self.warm == "part" else self.count)
        self.value += (x - self.value) * self.weight
        return self.value


def ema(n: int) -> Smoothed:
    return Smoothed(n, 2 / (n + 1), gap="seed")


def chained_ema(n: int) -> Smoothed:
    """For lines that others are made of: missing values are skipped."""
    return Smoothed(n, 2 / (n + 1))


def partial_ema(n: int) -> Smoothed:
    return Smoothed(n, 2 / (n + 1), warm="part")


def wilder(n: int) -> Smoothed:
    return Smoothed(n, 1 / n, gap="all")


def expanding_wilder(n: int) -> Smoothed:
    return Smoothed(n, 1 / n, warm="mean")


class TrueRange(Kernel):
    """Reach of a bar including the close before; the first bar's is its own range."""

    def __init__(self) -> None:
        self.before: Value = None

    def push(self, high: Value, low: Value, close: Value) -> Value:
        return self.take(high, low, close)

    def take(self, high: Value, low: Value, close: Value) -> Value:
        if high is None or low is None or close is None:
            return None
        reach = high - low if self.before is None else max(high, self.before) - min(low, self.before)
        self.before = close
        return reach


class Rsi(Kernel):
    """Smoothed gains over smoothed moves. An unchanged value repeats the last result, no moves at all give 50."""

    def __init__(self, n: int, array: bool = False) -> None:
        self.n, self.array = n, array
        self.before: Value = None
        self.started, self.last = False, None
        self.gain, self.loss = Smoothed(n, 1 / n, warm="part"), Smoothed(n, 1 / n, warm="part")

    @property
    def formed(self) -> bool:
        return self.gain.formed

    def push(self, x: Value) -> Value:
        return self.take(x)

    def take(self, x: Value) -> Value:
        if not self.started:
            self.started, self.before = x is not None, x
            return None
        delta, self.before = minus(x, self.before), x
        if delta is None:
            return None
        gain, loss = self.gain.push(max(delta, 0.0)), self.loss.push(max(-delta, 0.0))
        if not self.array and not self.formed:
            return None
        if delta == 0 and self.last is not None:
            return self.last
        if gain + loss == 0:
            return 50.0 if self.last is None else self.last
        self.last = 100 * gain / (gain + loss)
        return self.last


class Macd(Kernel):
    """Difference of two means and, once that is there, its own mean."""

    def __init__(self, fast: int, slow: int, signal: int = 0, relative: bool = False) -> None:
        self.fast, self.slow = chained_ema(fast), chained_ema(slow)
        self.signal = chained_ema(signal) if signal else None
        self.relative = relative

    def push(self, x: Value) -> tuple[Value, Value, Value]:
        return self.take(x)

    def take(self, x: Value) -> tuple[Value, Value, Value]:
        a, b = self.fast.push(x), self.slow.push(x)
        gap = minus(a, b)
        if self.relative and gap is not None:
            gap = 0.0 if abs(b) <= abs(a) * 1e-12 else 100 * gap / b
        mean = self.signal.push(gap) if self.signal and gap is not None else None
        return gap, mean, minus(gap, mean)


class Directional(Kernel):
    """Smoothed shares of upward and downward reach, and their contrast.

    The series' first bar adds its own range. A bar without one of the three prices is
    none to be measured against, so the bar after it adds nothing.
    """

    def __init__(self, n: int) -> None:
        self.n, self.first = n, True
        self.before: tuple[float, float, float] | None = None
        self.plus, self.minus, self.reach = expanding_wilder(n), expanding_wilder(n), expanding_wilder(n)

    def push(self, high: Value, low: Value, close: Value) -> tuple[float, float, float] | None:
        return self.take(high, low, close)

    def take(self, high: Value, low: Value, close: Value) -> tuple[float, float, float] | None:
        first, before = self.first, self.before
        self.first, self.before = False, None if None in (high, low, close) else (high, low, close)
        if high is None or low is None:
            return None
        if before is None:
            if first:
                self.reach.push(high - low)
            return None
        up, down = high - before[0], before[1] - low
        reach = self.reach.push(max(high - low, abs(high - before[2]), abs(low - before[2])))
        a = self.plus.push(up if up > down and up > 0 else 0.0)
        b = self.minus.push(down if down > up and down > 0 else 0.0)
        a, b = divide(100 * a, reach, 0.0), divide(100 * b, reach, 0.0)
        return a, b, divide(100 * abs(a - b), a + b, 0.0)


class Aroon(Kernel):
    """Age of the window's extremes. When an extreme leaves, its follower's age is counted from the window's old end.

    A forming bar is an extreme only if it goes beyond, and an age then goes on past the window.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        self.sides = [Extreme(n, 1), Extreme(n, -1)]
        self.best: list[Value] = [None, None]
        self.age = [0, 0]

    def preview(self, high: Value, low: Value) -> tuple[Value, Value]:
        if high is None or low is None or not self.sides[0].full:
            return None, None
        ages = (0 if high > self.best[0] else self.age[0] + 1), (0 if low < self.best[1] else self.age[1] + 1)
        return tuple(100 * (self.n - a) / self.n for a in ages)

    def take(self, high: Value, low: Value) -> tuple[Value, Value]:
        if high is None or low is None:
            return None, None
        for k, x in enumerate((high, low)):
            window, sign = self.sides[k], 1 if k == 0 else -1
            if self.best[k] is None or (x - self.best[k]) * sign >= 0:
                self.best[k], self.age[k] = x, 0
            else:
                self.age[k] += 1
            if window.full and window.items[0] == self.best[k]:
                self.best[k], self.age[k] = x, 0
                for place in range(1, self.n):
                    if (window.items[place] - self.best[k]) * sign > 0:
                        self.best[k], self.age[k] = window.items[place], place
            window.push(x)
        if not self.sides[0].full:
            return None, None
        return tuple(100 * (self.n - a) / self.n for a in self.age)
