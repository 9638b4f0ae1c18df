"""Indicators that are expressions of bounded or growing windows of bars.

Each function gives the formula for a dialect and resolved parameters. A window
with a missing value has no value; a line starts once its windows are full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.dialect import Dialect, Formula

Builder = Callable[[Dialect, dict], Formula]
WINDOWED: dict[str, Builder] = {}

TP = "(high + low + close) / 3"
HL2 = "(high + low) / 2"
GOLDEN = {"l236": 0.236, "l382": 0.382, "l500": 0.5, "l618": 0.618, "l786": 0.786}


def indicator(name: str) -> Callable[[Builder], Builder]:
    def keep(build: Builder) -> Builder:
        WINDOWED[name] = build
        return build

    return keep


def line(expression: str, *steps: tuple[str, str], out: str = "line") -> Formula:
    return Formula({out: expression}, list(steps))


def _of_bar(name: str, expression: str, out: str = "line") -> None:
    WINDOWED[name] = lambda q, p: line(expression.format(zero=q.number(0), one=q.number(1)), out=out)


# One bar
_of_bar("PassThroughIndicator", "close")
_of_bar("MedianPrice", HL2)
_of_bar("TypicalPrice", TP)
_of_bar("WeightedClosePrice", "(high + low + 2 * close) / 4")
_of_bar("VolumeIndicator", "volume", out="value")
_of_bar("MarketFacilitationIndex", "(high - low) / nullif(volume, {zero})")


@indicator("LunarPhase")
def lunar_phase(q: Dialect, p: dict) -> Formula:
    """Eighths of the synodic month since a new moon; Julian days from UNIX seconds."""
    n = q.number
    turns = f"((CAST(time AS DOUBLE) / {n(86400)} + {n(2440587.5)} - {n(2451549.5)}) / {n(29.53)})"
    return line(f"CAST(floor({n(8)} * (turns - floor(turns))) AS DOUBLE)", ("turns", turns))


@indicator("BalanceOfPower")
def balance_of_power(q: Dialect, p: dict) -> Formula:
    """A forming bar has none."""
    return line(q.forms("CAST(NULL AS DOUBLE)", q.clamp(q.divide("close - open", "high - low"), -1, 1)))


@indicator("PivotPoints")
def pivot_points(q: Dialect, p: dict) -> Formula:
    return Formula(
        {"pp": "pp", "r1": "2 * pp - low", "r2": "pp + (high - low)", "s1": "2 * pp - high", "s2": "pp - (high - low)"}, [("pp", TP)]
    )


@indicator("SineWave")
def sine_wave(q: Dialect, p: dict) -> Formula:
    turn = q.number(2 * math.pi / p["length"])
    return Formula({"sine": f"sin({turn} * i)", "leadsine": f"sin({turn} * (i + {q.number(0.5)}))"})


# Earlier bars
def _past(q: Dialect, n: int) -> str:
    """The close n bars ago; one bar further back from a bar that is still forming."""
    return q.forms(q.lag("close", n + 1), q.lag("close", n))


@indicator("Momentum")
def momentum(q: Dialect, p: dict) -> Formula:
    return line(f"close - {_past(q, p['length'])}")


@indicator("RateOfChange")
def rate_of_change(q: Dialect, p: dict) -> Formula:
    return line(f"100 * ({q.divide('close - base', 'base')})", ("base", _past(q, p["length"])))


@indicator("Shift")
def shift(q: Dialect, p: dict) -> Formula:
    return line(f"CASE WHEN i >= {p['length']} THEN close END")


@indicator("TrueRange")
def true_range(q: Dialect, p: dict) -> Formula:
    """The close before is that of the last bar with a range."""
    reach = "greatest(high - low, abs(before - high), abs(before - low))"
    ranged = f"CASE WHEN {q.both('high', 'low')} THEN close END"
    return line(f"CASE WHEN {q.both('before', 'high', 'low')} THEN {reach} END", ("ranged", ranged), ("before", q.before("ranged")))


# From the first bar on
@indicator("AccumulationDistributionLine")
def accumulation_distribution(q: Dialect, p: dict) -> Formula:
    term = f"coalesce({q.divide('(close - low) - (high - close)', 'high - low')} * volume, {q.number(0)})"
    return line(q.cumulative("term"), ("term", term))


def _obv(q: Dialect) -> list[tuple[str, str]]:
    """Bars without close or volume have no value and change nothing."""
    return [
        ("ok", q.flag(q.both("close", "volume"))), ("met", "CASE WHEN ok = 1 THEN close END"), ("before", q.before("met")),
        ("flow", f"CASE WHEN ok = 1 AND before <> 0 AND close > before THEN volume WHEN ok = 1 AND before <> 0 AND close < before THEN -volume ELSE {q.number(0)} END"),
        ("obv", f"CASE WHEN ok = 1 THEN {q.cumulative('flow')} END"),
    ]


@indicator("BalanceVolume")
def balance_volume(q: Dialect, p: dict) -> Formula:
    """The first close sets out, with or without a volume; it, and bars after a close of zero, have no value."""
    steps = [
        ("first", q.flag(f"{q.before('close')} IS NULL")), ("met", f"CASE WHEN {q.both('volume')} OR first = 1 THEN close END"), ("before", q.before("met")),
        ("ok", q.flag(f"{q.both('close', 'volume')} AND before <> 0")),
        ("flow", f"CASE WHEN ok = 1 AND close > before THEN volume WHEN ok = 1 AND close < before THEN -volume ELSE {q.number(0)} END"),
    ]
    return line(f"CASE WHEN ok = 1 THEN {q.cumulative('flow')} END", *steps)


@indicator("OnBalanceVolume")
def on_balance_volume(q: Dialect, p: dict) -> Formula:
    return line("obv", *_obv(q))


@indicator("OnBalanceVolumeMean")
def on_balance_volume_mean(q: Dialect, p: dict) -> Formula:
    return line(q.mean("obv", p["length"]), *_obv(q))


@indicator("ChaikinMoneyFlow")
def chaikin_money_flow(q: Dialect, p: dict) -> Formula:
    """What leaves the window is taken from both sums, as the money flow it was; a gap in the window leaves no value."""
    n, zero = p["length"], q.number(0)
    share = f"CASE WHEN high = low THEN {zero} ELSE ((close - low) - (high - close)) / (high - low) END"
    return line(
        f"CASE WHEN count(flow) {q.over(n)} = {n} THEN CASE WHEN below = 0 THEN {zero} ELSE {q.divide('above', 'below')} END END",
        ("flow", f"CASE WHEN {q.both('high', 'low', 'close', 'volume')} THEN ({share}) * volume END"),
        ("traded", "CASE WHEN flow IS NOT NULL THEN volume END"),
        ("gone", q.lag("flow", n)),
        ("above", q.frame("sum(flow)", n)),
        ("below", f"coalesce({q.cumulative('traded')}, {zero}) - coalesce({q.cumulative('gone')}, {zero})"),
    )


@indicator("PriceVolumeTrend")
def price_volume_trend(q: Dialect, p: dict) -> Formula:
    steps = [
        ("met", f"CASE WHEN {q.both('close', 'volume')} THEN close END"), ("before", q.before("met")), ("ok", q.flag(f"{q.both('met')} AND before <> 0")),
        ("term", f"CASE WHEN ok = 1 THEN volume * (close - before) / before END"),
    ]
    return line(f"CASE WHEN ok = 1 THEN {q.cumulative('term')} END", *steps)


@indicator("VolumeWeightedAveragePrice")
def vwap(q: Dialect, p: dict) -> Formula:
    steps = [("money", f"{TP} * volume"), ("traded", "CASE WHEN money IS NOT NULL THEN volume END"), ("total", q.cumulative("traded"))]
    return line(f"CASE WHEN total > 0 THEN {q.cumulative('money')} / total END", *steps)


@indicator("TimeWeightedAveragePrice")
def twap(q: Dialect, p: dict) -> Formula:
    steps = [("tp", TP), ("there", q.flag(q.both("tp")))]
    return line(f"CASE WHEN there = 1 THEN {q.cumulative('tp')} / {q.cumulative('there')} END", *steps)


@indicator("WilliamsAccumulationDistribution")
def williams_ad(q: Dialect, p: dict) -> Formula:
    steps = [
        ("before", q.before("close")), ("ok", q.flag(f"{q.both('high', 'low', 'close')} AND before <> 0")),
        ("reach", f"CASE WHEN close > before THEN close - least(low, before) WHEN close < before THEN close - greatest(high, before) ELSE {q.number(0)} END"),
        ("term", "CASE WHEN ok = 1 THEN reach END"),
    ]
    return line(f"CASE WHEN ok = 1 THEN {q.cumulative('term')} END", *steps)


@indicator("WilliamsVariableAccumulationDistribution")
def williams_variable_ad(q: Dialect, p: dict) -> Formula:
    return line(q.cumulative("term"), ("term", f"coalesce({q.divide('close - open', 'high - low')} * volume, {q.number(0)})"))


# Means and sums of the last bars
@indicator("SimpleMovingAverage")
def sma(q: Dialect, p: dict) -> Formula:
    return line(q.mean("close", p["length"]))


@indicator("Sum")
def rolling_sum(q: Dialect, p: dict) -> Formula:
    return line(q.total("close", p["length"]))


@indicator("EndpointMovingAverage")
def endpoint(q: Dialect, p: dict) -> Formula:
    """A line through the first and the last close of the window, read at its end: the last close."""
    n = p["length"]
    return line("CAST(NULL AS DOUBLE)" if n == 1 else q.full("max(close)", "close", n).replace(f"max(close) {q.over(n)}", "close"))


def _weighted_mean(q: Dialect, x: str, n: int) -> str:
    return f"{q.weighted(q.window(x, n), [float(k) for k in range(1, n + 1)])} / {q.number(n * (n + 1) / 2)}"


@indicator("WeightedMovingAverage")
def wma(q: Dialect, p: dict) -> Formula:
    return line(_weighted_mean(q, "close", p["length"]))


@indicator("HullMovingAverage")
def hull(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    half, root = n // 2, p["sqrtPeriod"] or math.isqrt(n)
    if half < 1:
        return line("CAST(NULL AS DOUBLE)")
    gap = f"2 * ({_weighted_mean(q, 'close', half)}) - ({_weighted_mean(q, 'close', n)})"
    return line(_weighted_mean(q, "gap", root), ("gap", gap))


@indicator("ArnaudLegouxMovingAverage")
def alma(q: Dialect, p: dict) -> Formula:
    """Weight k counts from the newest bar, so the peak is near the oldest."""
    n, middle, width = p["length"], p["offset"] * (p["length"] - 1), p["length"] / p["sigma"]
    weights = [math.exp(-(((k - middle) / width) ** 2) / 2) for k in range(n)]
    return line(f"{q.weighted(q.window('close', n), weights[::-1])} / {q.number(sum(weights))}")


@indicator("Median")
def median(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    middle = q.at("w", n // 2) if n % 2 else f"({q.at('w', n // 2 - 1)} + {q.at('w', n // 2)}) / 2"
    return line(middle, ("w", q.sorted(q.window("close", n))))


@indicator("MovingAverageCrossover")
def crossover(q: Dialect, p: dict) -> Formula:
    return line(f"CAST(sign(({q.mean('close', p['shortPeriod'])}) - ({q.mean('close', p['longPeriod'])})) AS DOUBLE)", out="signal")


@indicator("MovingAverageRibbon")
def ribbon(q: Dialect, p: dict) -> Formula:
    """Each line averages the one before."""
    step = math.trunc((p["longPeriod"] - p["shortPeriod"]) / (p["ribbonCount"] - 1))
    steps, before = [], "close"
    for k in range(p["ribbonCount"]):
        steps.append((f"r{k}", q.mean(before, p["shortPeriod"] + k * step)))
        before = f"r{k}"
    return Formula({f"ribbon{k}": f"r{k}" for k in range(p["ribbonCount"])}, steps)


@indicator("RainbowCharts")
def rainbow(q: Dialect, p: dict) -> Formula:
    return Formula({f"sma{k}": q.mean("close", 2 * k) for k in range(1, p["lines"])})


@indicator("AwesomeOscillator")
def awesome(q: Dialect, p: dict) -> Formula:
    return line(f"({q.mean('m', p['shortMaLength'])}) - ({q.mean('m', p['longMaLength'])})", ("m", HL2), out="value")


@indicator("Acceleration")
def acceleration(q: Dialect, p: dict) -> Formula:
    ao = f"({q.mean('m', p['shortMaLength'])}) - ({q.mean('m', p['longMaLength'])})"
    return line(f"ao - ({q.mean('ao', p['smaLength'])})", ("m", HL2), ("ao", ao))


@indicator("ElliotWaveOscillator")
def elliot_wave(q: Dialect, p: dict) -> Formula:
    return line(f"({q.mean('close', p['shortPeriod'])}) - ({q.mean('close', p['longPeriod'])})")


def _two_means(q: Dialect, short: int, long: int) -> list[tuple[str, str]]:
    return [("fast", q.mean("close", short)), ("slow", q.mean("close", long))]


@indicator("OscillatorOfMovingAverage")
def oscillator_of_ma(q: Dialect, p: dict) -> Formula:
    value = f"CASE WHEN {q.both('fast', 'slow')} THEN coalesce(100 * ({q.divide('fast - slow', 'slow')}), {q.number(0)}) END"
    return line(value, *_two_means(q, p["shortPeriod"], p["longPeriod"]))


@indicator("RangeActionVerificationIndex")
def ravi(q: Dialect, p: dict) -> Formula:
    return line(f"abs(100 * ({q.divide('fast - slow', 'slow')}))", *_two_means(q, p["shortSmaLength"], p["longSmaLength"]))


@indicator("DisparityIndex")
def disparity(q: Dialect, p: dict) -> Formula:
    return line(f"100 * ({q.divide('close - m', 'm')})", ("m", q.mean("close", p["length"])))


@indicator("QStick")
def qstick(q: Dialect, p: dict) -> Formula:
    return line(q.mean("gap", p["length"]), ("gap", "open - close"))


@indicator("BalanceOfMarketPower")
def balance_of_market_power(q: Dialect, p: dict) -> Formula:
    share = f"(close - open) / CASE WHEN high = low THEN {q.number(0.01)} ELSE high - low END"
    raw = f"CASE WHEN {q.both('open', 'high', 'low', 'close')} THEN CASE WHEN coalesce(volume, 0) = 0 THEN {q.number(0)} ELSE {share} END END"
    return line(q.mean("raw", p["length"]), ("raw", raw))


@indicator("FiniteVolumeElement")
def finite_volume(q: Dialect, p: dict) -> Formula:
    """Bars without a range, a close or a volume count as zero. A forming bar stands for the last final one in the mean."""
    raw = f"CASE WHEN coalesce(volume, 0) = 0 THEN {q.number(0)} ELSE coalesce(2 * ({q.divide('close - low', 'high - low')}) - 1, {q.number(0)}) END"
    n = p["length"]
    preview = f"({q.full('sum(raw)', 'raw', n + 1)} - {q.lag('raw')}) / {n}"
    return line(f"100 * ({q.forms(preview, q.mean('raw', n))})", ("raw", raw))


@indicator("IntradayIntensityIndex")
def intraday_intensity(q: Dialect, p: dict) -> Formula:
    share = q.divide("2 * ((close - low) - (high - close))", f"(high - low) * coalesce(volume, {q.number(0)})")
    return line(q.mean("raw", p["length"]), ("raw", f"CASE WHEN {q.both('high', 'low', 'close')} THEN coalesce({share}, {q.number(0)}) END"))


@indicator("VolumeWeightedMovingAverage")
def vwma(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line(q.divide("above", "below"), ("money", "close * volume"), ("above", q.total("money", n)), ("below", q.total("volume", n)))


@indicator("KnowSureThing")
def know_sure_thing(q: Dialect, p: dict) -> Formula:
    """Every mean starts to fill once the longest rate of change is there, and rests on bars without it; so does the signal without a value."""
    start, steps = p["roc4Length"], []
    for k in range(1, 5):
        steps.append((f"b{k}", _past(q, p[f"roc{k}Length"])))
        change = f"100 * ({q.divide(f'close - b{k}', f'b{k}')})"
        steps.append((f"c{k}", f"CASE WHEN i >= {start} THEN {change} END"))
    steps.append(("ok", q.flag(q.both("c4"))))
    means = " + ".join(f"{k} * ({q.filled(f'avg(c{k})', f'c{k}', 'ok', p[f'sma{k}Length'])})" for k in range(1, 5))
    steps += [("kst", means), ("said", q.flag(q.both("kst")))]
    return Formula({"kst": "kst", "signal": q.filled("avg(kst)", "kst", "said", p["signalLength"])}, steps)


# Ranges
@indicator("Highest")
def highest(q: Dialect, p: dict) -> Formula:
    return line(q.high("close", p["length"]))


@indicator("Lowest")
def lowest(q: Dialect, p: dict) -> Formula:
    return line(q.low("close", p["length"]))


def _range(q: Dialect, n: int) -> list[tuple[str, str]]:
    return [("hi", q.high("high", n)), ("lo", q.low("low", n))]


@indicator("DonchianChannels")
def donchian(q: Dialect, p: dict) -> Formula:
    """The middle of a forming bar is that of the bar before."""
    middle = q.forms(f"({q.lag('hi')} + {q.lag('lo')}) / 2", "(hi + lo) / 2")
    return Formula({"upper": "hi", "middle": middle, "lower": "lo"}, _range(q, p["length"]))


@indicator("PriceChannels")
def price_channels(q: Dialect, p: dict) -> Formula:
    return Formula({"upper": "hi", "lower": "lo"}, _range(q, p["length"]))


@indicator("DetrendedSyntheticPrice")
def detrended_synthetic(q: Dialect, p: dict) -> Formula:
    return line("(hi + lo) / 2", *_range(q, p["length"]))


@indicator("FibonacciRetracement")
def fibonacci(q: Dialect, p: dict) -> Formula:
    """Windows that still fill have values; a gap in one leaves none."""
    n = p["length"]

    def whole(k: int) -> str:
        return f"(count(high) {q.over(k)} = count(*) {q.over(k)} AND count(low) {q.over(k)} = count(*) {q.over(k)})"

    steps = [
        ("hi", q.forms(q.frame("max(high)", n + 1), q.frame("max(high)", n))), ("lo", q.forms(q.frame("min(low)", n + 1), q.frame("min(low)", n))),
        ("whole", q.flag(q.forms(whole(n + 1), whole(n)))),
    ]
    return Formula({k: f"CASE WHEN whole = 1 THEN lo + (hi - lo) * {q.number(x)} END" for k, x in GOLDEN.items()}, steps)


@indicator("StochasticK")
def stochastic_k(q: Dialect, p: dict) -> Formula:
    value = f"CASE WHEN {q.both('hi', 'lo', 'close')} THEN coalesce(100 * ({q.divide('close - lo', 'hi - lo')}), {q.number(0)}) END"
    return line(value, *_range(q, p["length"]))


@indicator("StochasticOscillator")
def stochastic(q: Dialect, p: dict) -> Formula:
    value = f"CASE WHEN {q.both('hi', 'lo', 'close')} THEN coalesce(100 * ({q.divide('close - lo', 'hi - lo')}), {q.number(0)}) END"
    return Formula({"k": "k", "d": q.mean("k", p["dLength"])}, [*_range(q, p["kLength"]), ("k", value)])


@indicator("WilliamsR")
def williams_r(q: Dialect, p: dict) -> Formula:
    """A forming bar with a gap in the window before it has only its own range."""
    n = p["length"]
    hi = q.forms(f"coalesce({q.full('max(high)', 'high', n + 1)}, high)", q.high("high", n))
    lo = q.forms(f"coalesce({q.full('min(low)', 'low', n + 1)}, low)", q.low("low", n))
    return line(f"-100 * ({q.divide('hi - close', 'hi - lo')})", ("hi", hi), ("lo", lo))


@indicator("HighLowIndex")
def high_low_index(q: Dialect, p: dict) -> Formula:
    value = f"CASE WHEN {q.both('hi', 'lo', 'high')} THEN coalesce(100 * ({q.divide('high - lo', 'hi - lo')}), {q.number(50)}) END"
    return line(value, *_range(q, p["length"]))


@indicator("PrettyGoodOscillator")
def pretty_good(q: Dialect, p: dict) -> Formula:
    return line(f"100 * ({q.divide('close - m', 'hi - lo')})", *_range(q, p["length"]), ("m", q.mean("close", p["length"])))


@indicator("MomentumPinball")
def momentum_pinball(q: Dialect, p: dict) -> Formula:
    """Over the last closes there were; bars without one have no value. A forming bar is held against the final ones."""
    n = p["length"]
    steps = [
        ("ok", q.flag(q.both("close"))), ("top", q.filled("max(close)", "close", "ok", n)), ("low_", q.filled("min(close)", "close", "ok", n)),
        ("hi", q.forms(q.earlier("top", "ok", 1), "top")), ("lo", q.forms(q.earlier("low_", "ok", 1), "low_")),
        ("base", q.forms(q.earlier("close", "ok", n), q.earlier("close", "ok", n - 1))),
    ]
    return line(f"CASE WHEN {q.both('close', 'hi', 'lo', 'base')} THEN coalesce(100 * ({q.divide('close - base', 'hi - lo')}), {q.number(0)}) END", *steps)


@indicator("GopalakrishnanRangeIndex")
def gopalakrishnan(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    if n == 1:
        return line("CAST(NULL AS DOUBLE)")
    value = f"CASE WHEN high - low <= 0 THEN {q.number(0)} ELSE ln({q.divide('hi - lo', 'high - low')}) / {q.number(math.log(n))} END"
    return line(f"CASE WHEN {q.both('hi', 'lo')} THEN {value} END", *_range(q, n))


@indicator("ChandeKrollStop")
def chande_kroll(q: Dialect, p: dict) -> Formula:
    """The stops' means are over the last stops there were, and divide by the whole length while they fill."""
    n, k = p["period"], p["stopPeriod"]
    steps = [*_range(q, n), ("a", f"hi - (hi - lo) * {q.number(p['multiplier'])}"), ("b", f"lo + (hi - lo) * {q.number(p['multiplier'])}"), ("ok", q.flag(q.both("hi", "lo")))]


    def mean(x: str) -> str:
        """A forming bar takes the place of the oldest stop, also while they fill."""
        total = q.among(f"sum({x})", "ok", k)
        oldest = f"CASE WHEN {q.among(f'count({x})', 'ok', k + 1)} <= {k} THEN {q.among(f'first_value({x})', 'ok', k + 1)} ELSE {q.number(0)} END"
        return f"CASE WHEN ok = 1 THEN ({q.forms(f'{total} - {oldest}', total)}) / {k} END"

    return Formula({"longStop": mean("a"), "shortStop": mean("b")}, steps)


@indicator("Ichimoku")
def ichimoku(q: Dialect, p: dict) -> Formula:
    """Values as they stand on each bar: the spans were computed ``kijunLength`` bars before."""
    t, k, b = p["tenkanLength"], p["kijunLength"], p["senkouBLength"]

    def middle(n: int) -> str:
        """A forming bar takes the place of the oldest one here."""
        return f"(({q.full('max(high)', 'high', n)}) + ({q.full('min(low)', 'low', n)})) / 2"

    steps = [("t", middle(t)), ("k", middle(k)), ("a", "(t + k) / 2"), ("b", middle(b) if b >= k else "CAST(NULL AS DOUBLE)")]

    def drawn(x: str, first: int) -> str:
        """The first value also stands one bar earlier."""
        return f"CASE WHEN i = {first + k - 1} THEN {q.lag(x, k - 1)} ELSE {q.lag(x, k)} END"

    return Formula(
        {
            "tenkan": "t", "kijun": "k",
            "senkouA": drawn("a", max(t, k) - 1), "senkouB": drawn("b", max(b, k) - 1) if b >= k else "b",
            "chikou": f"CASE WHEN i >= {p['chinkouLength'] - 1} THEN close END",
        },
        steps,
    )


@indicator("DetrendedPriceOscillator")
def detrended_price(q: Dialect, p: dict) -> Formula:
    """Against a mean some means back; bars without a mean look back from the last one there was."""
    n = p["length"]
    back = min(n - 1, n // 2 + 1)
    steps = [
        ("m", q.mean("close", n)), ("ok", q.flag(q.both("m"))), ("met", f"CASE WHEN ok = 1 THEN {q.earlier('m', 'ok', back)} END"),
        ("kept", f"coalesce(met, {q.before('met')})"), ("means", q.cumulative("ok")),
    ]
    return line(f"CASE WHEN means >= {n} THEN close - {q.forms(q.lag('kept'), 'kept')} END", *steps)


@indicator("KaufmanEfficiencyRatio")
def efficiency(q: Dialect, p: dict) -> Formula:
    """A forming bar makes the path a bar longer."""
    n = p["length"]
    path = q.frame("sum(move)", n - 1) if n > 1 else q.number(0)
    steps = [
        ("move", f"abs(close - {q.lag('close')})"), ("base", q.forms(q.lag("close", n), q.lag("close", n - 1))), ("path", q.forms(q.frame("sum(move)", n), path)),
        ("whole", q.flag(q.forms(f"count(close) {q.over(n + 1)} = {n + 1}", f"count(close) {q.over(n)} = {n}"))),
    ]
    return line(f"CASE WHEN whole = 1 THEN coalesce({q.divide('abs(close - base)', 'path')}, {q.number(0)}) END", *steps)


@indicator("VerticalHorizontalFilter")
def vertical_horizontal(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line(q.divide("hi - lo", "path"), *_range(q, n), ("move", f"abs(close - {q.lag('close')})"), ("path", q.total("move", n)))


@indicator("FractalDimension")
def fractal_dimension(q: Dialect, p: dict) -> Formula:
    """Over the last closes there were."""
    n = p["length"]
    if n == 1:
        return line("CAST(NULL AS DOUBLE)")
    steps = [
        ("ok", q.flag(q.both("close"))), ("move", f"CASE WHEN ok = 1 THEN abs(close - {q.before('close')}) END"), ("path", q.among("sum(move)", "ok", n - 1)),
        ("hi", q.forms(q.filled("max(close)", "close", "ok", n + 1), q.filled("max(close)", "close", "ok", n))),
        ("lo", q.forms(q.filled("min(close)", "close", "ok", n + 1), q.filled("min(close)", "close", "ok", n))),
    ]
    log = f"1 + (ln(path) - ln(hi - lo)) / {q.number(math.log(2 * (n - 1)))}"
    value = f"CASE WHEN hi - lo > 0 AND path > 0 THEN {q.clamp(log, 1, 2)} ELSE {q.number(1.5)} END"
    return line(f"CASE WHEN {q.both('hi', 'lo')} THEN {value} END", *steps)


# Moves up and down


# Moves up and down
def _moves(q: Dialect, base: str) -> list[tuple[str, str]]:
    zero = q.number(0)
    return [
        ("d", f"close - {base}"),
        ("up", f"CASE WHEN d IS NOT NULL THEN greatest(d, {zero}) END"),
        ("down", f"CASE WHEN d IS NOT NULL THEN greatest(-d, {zero}) END"),
    ]


@indicator("ChandeMomentumOscillator")
def chande_momentum(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    steps = [*_moves(q, q.lag("close")), ("u", q.total("up", n)), ("v", q.total("down", n))]
    return line(f"CASE WHEN {q.both('u', 'v')} THEN coalesce(100 * ({q.divide('u - v', 'u + v')}), {q.number(0)}) END", *steps)


@indicator("RelativeMomentumIndex")
def relative_momentum(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line(f"100 * ({q.divide('u', 'u + v')})", *_moves(q, _past(q, p["momentumPeriod"])), ("u", q.mean("up", n)), ("v", q.mean("down", n)))


@indicator("DeMarker")
def demarker(q: Dialect, p: dict) -> Formula:
    """Over the last bars with a range; others are passed over."""
    n, zero = p["length"], q.number(0)
    steps = [
        ("ok", q.flag(q.both("high", "low"))), ("dh", f"high - {q.earlier('high', 'ok', 1)}"), ("dl", f"{q.earlier('low', 'ok', 1)} - low"),
        ("up", f"CASE WHEN dh IS NOT NULL THEN greatest(dh, {zero}) END"), ("down", f"CASE WHEN dl IS NOT NULL THEN greatest(dl, {zero}) END"),
        ("u", q.filled("avg(up)", "up", "ok", n)), ("v", q.filled("avg(down)", "down", "ok", n)),
    ]
    return line(f"CASE WHEN {q.both('u', 'v')} THEN coalesce({q.divide('u', 'u + v')}, {q.number(0.5)}) END", *steps)


@indicator("IntradayMomentumIndex")
def intraday_momentum(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    steps = [("up", f"greatest(close - open, {q.number(0)})"), ("all_", "abs(close - open)"), ("u", q.total("up", n)), ("w", q.total("all_", n))]
    return line(f"CASE WHEN {q.both('u', 'w')} THEN coalesce(100 * ({q.divide('u', 'w')}), {q.number(0)}) END", *steps)


@indicator("MoneyFlowIndex")
def money_flow(q: Dialect, p: dict) -> Formula:
    """Against the last typical price there was; bars without one, or a volume, count as no flow and have no value."""
    n, zero = p["length"], q.number(0)
    steps = [
        ("tp", f"CASE WHEN {q.both('volume')} THEN {TP} END"), ("before", f"coalesce({q.before('tp')}, {zero})"),
        ("gain", f"CASE WHEN tp > before THEN tp * volume ELSE {zero} END"), ("loss", f"CASE WHEN tp < before THEN tp * volume ELSE {zero} END"),
        ("u", q.total("gain", n)), ("v", q.total("loss", n)),
    ]
    return line(f"CASE WHEN {q.both('tp', 'u', 'v')} THEN CASE WHEN v = 0 THEN {q.number(100)} ELSE 100 * ({q.divide('u', 'u + v')}) END END", *steps)


@indicator("UltimateOscillator")
def ultimate(q: Dialect, p: dict) -> Formula:
    whole = q.both("high", "low", "close")
    steps = [
        ("met", f"CASE WHEN {whole} THEN close END"), ("before", q.before("met")),
        ("bp", f"CASE WHEN {whole} AND {q.both('before')} THEN close - least(low, before) END"),
        ("tr", f"CASE WHEN {whole} AND {q.both('before')} THEN greatest(high, before) - least(low, before) END"),
    ]
    for n in (7, 14, 28):
        steps.append((f"s{n}", f"({q.total('bp', n)}) / nullif({q.total('tr', n)}, {q.number(0)})"))
    return line("100 * (4 * s7 + 2 * s14 + s28) / 7", *steps)


@indicator("VortexIndicator")
def vortex(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    steps = [
        ("c1", q.lag("close")), ("h1", q.lag("high")), ("l1", q.lag("low")), ("ok", q.flag(f"{q.both('high', 'low', 'h1', 'l1')} AND c1 <> 0")),
        ("tr", "CASE WHEN ok = 1 THEN greatest(high - low, abs(high - c1), abs(low - c1)) END"),
        ("a", "CASE WHEN ok = 1 THEN abs(high - l1) END"), ("b", "CASE WHEN ok = 1 THEN abs(low - h1) END"),
        ("u", q.total("a", n)), ("v", q.total("b", n)), ("w", q.total("tr", n)),
    ]
    share = lambda x: f"CASE WHEN {q.both(x, 'w')} THEN coalesce({q.divide(x, 'w')}, {q.number(0)}) END"
    return Formula({"viPlus": share("u"), "viMinus": share("v")}, steps)


@indicator("ChoppinessIndex")
def choppiness(q: Dialect, p: dict) -> Formula:
    """Over the last bars with prices; the first of all compares with zero."""
    n = p["length"]
    if n == 1:
        return line("CAST(NULL AS DOUBLE)")
    steps = [
        ("ok", q.flag(q.both("high", "low", "close"))), ("before", f"coalesce({q.earlier('close', 'ok', 1)}, {q.number(0)})"),
        ("tr", "CASE WHEN ok = 1 THEN greatest(high - low, abs(high - before), abs(low - before)) END"), ("r", "CASE WHEN ok = 1 THEN high - low END"),
        ("u", q.filled("sum(tr)", "tr", "ok", n)), ("v", q.filled("sum(r)", "r", "ok", n)),
    ]
    return line(f"CASE WHEN u > 0 AND v > 0 THEN 100 * log10(u / v) / {q.number(math.log10(n))} END", *steps)


# Spread


# Spread
@indicator("StandardDeviation")
def standard_deviation(q: Dialect, p: dict) -> Formula:
    return line(q.deviation("close", p["length"]))


def _last_spread(q: Dialect, n: int) -> list[tuple[str, str]]:
    """Mean and deviation; a forming bar is held against those of the bar before."""
    return [("m", q.mean("close", n)), ("s", q.deviation("close", n)), ("base", q.forms(q.lag("m"), "m")), ("width", q.forms(q.lag("s"), "s"))]


@indicator("BollingerBands")
def bollinger(q: Dialect, p: dict) -> Formula:
    up, down = (p["upBandWidth"], p["lowBandWidth"]) if p["width"] == 2 else (p["width"], -p["width"])
    steps = [*_last_spread(q, p["length"])]
    return Formula({"upper": f"base + {q.number(up)} * width", "middle": "m", "lower": f"base + {q.number(down)} * width"}, steps)


@indicator("BollingerPercentB")
def percent_b(q: Dialect, p: dict) -> Formula:
    k = q.number(p["stdDevMultiplier"])
    return line(f"100 * ({q.divide(f'close - (base - {k} * width)', f'2 * {k} * width')})", *_last_spread(q, p["length"]))


@indicator("Envelope")
def envelope(q: Dialect, p: dict) -> Formula:
    k = p["shift"]
    return Formula({"upper": f"m * {q.number(1 + k)}", "middle": "m", "lower": f"m * {q.number(1 - k)}"}, [("m", q.mean("close", p["length"]))])


@indicator("HistoricalVolatilityRatio")
def volatility_ratio(q: Dialect, p: dict) -> Formula:
    steps = [("a", q.deviation("close", p["shortPeriod"])), ("b", q.deviation("close", p["longPeriod"]))]
    return line(f"CASE WHEN {q.both('a', 'b')} THEN coalesce({q.divide('a', 'b')}, {q.number(0)}) END", *steps)


def _mean_deviation(q: Dialect, n: int) -> str:
    return f"{q.add_up(q.map('w', 'z', 'abs(z - m)'))} / {n}"


@indicator("MeanDeviation")
def mean_deviation(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line(_mean_deviation(q, n), ("w", q.window("close", n)), ("m", f"{q.add_up('w')} / {n}"))


def _cci(q: Dialect, n: int) -> list[tuple[str, str]]:
    flat = f"{q.largest('w')} = {q.smallest('w')}"
    value = q.divide("tp - m", f"{q.number(0.015)} * s")
    return [
        ("tp", TP), ("w", q.window("tp", n)), ("m", f"{q.add_up('w')} / {n}"), ("s", f"CASE WHEN NOT ({flat}) THEN {_mean_deviation(q, n)} END"), ("cci", value),
    ]


@indicator("CommodityChannelIndex")
def cci(q: Dialect, p: dict) -> Formula:
    return line("cci", *_cci(q, p["length"]))


@indicator("WoodiesCCI")
def woodies(q: Dialect, p: dict) -> Formula:
    """The signal rests on bars without a value."""
    return Formula({"cci": "cci", "signal": q.filled("avg(cci)", "cci", "ok", p["smaLength"])}, [*_cci(q, p["length"]), ("ok", q.flag(q.both("cci")))])


# Least squares on the bar's index


# Least squares on the bar's index
def _fit(q: Dialect, n: int) -> list[tuple[str, str]]:
    x = "CAST(i AS DOUBLE)"
    return [("slope", q.full(f"regr_slope(close, {x})", "close", n)), ("m", q.mean("close", n))]


@indicator("LinearReg")
def linear_regression(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line("close" if n == 1 else f"m + slope * {q.number((n - 1) / 2)}", *_fit(q, n))


@indicator("LinearRegressionForecast")
def regression_forecast(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    return line("CAST(NULL AS DOUBLE)" if n == 1 else f"m + slope * {q.number((n + 1) / 2)}", *_fit(q, n))


@indicator("LinearRegSlope")
def regression_slope(q: Dialect, p: dict) -> Formula:
    return line("CAST(NULL AS DOUBLE)" if p["length"] == 1 else "slope", *_fit(q, p["length"]))


@indicator("ForecastOscillator")
def forecast_oscillator(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    if n == 1:
        return line(f"CASE WHEN close <> 0 THEN {q.number(0)} END")
    return line(f"100 * ({q.divide(f'close - (m + slope * {q.number((n - 1) / 2)})', 'close')})", *_fit(q, n))


@indicator("LinearRegRSquared")
def regression_r2(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    spread = f"var_pop(close) {q.over(n)}"
    share = f"slope * slope * {q.number((n * n - 1) / 12)}"
    value = f"CASE WHEN hi = lo THEN {q.number(0)} ELSE {q.clamp(q.divide(share, 'spread'), 0, 1)} END"
    steps = [*_fit(q, n), ("hi", q.full("max(close)", "close", n)), ("lo", q.full("min(close)", "close", n)), ("spread", spread)]
    return line(f"CASE WHEN m IS NOT NULL THEN {q.number(0) if n == 1 else value} END", *steps)


@indicator("StandardError")
def standard_error(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    if n <= 2:
        return line(f"CASE WHEN i >= {n - 1} AND close IS NOT NULL THEN {q.number(0)} END")
    left = f"(var_pop(close) {q.over(n)} - slope * slope * {q.number((n * n - 1) / 12)}) * {n} / {n - 2}"
    return line(f"CASE WHEN m IS NOT NULL THEN sqrt(greatest(left_, {q.number(0)})) END", *_fit(q, n), ("left_", left))


# Whole windows
@indicator("CenterOfGravityOscillator")
def center_of_gravity(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    moment = q.weighted("w", [float(k) for k in range(1, n + 1)])
    return line(f"{q.divide(moment, q.add_up('w'))} - {q.number((n + 1) / 2)}", ("w", q.window("close", n)))


@indicator("HarmonicOscillator")
def harmonic(q: Dialect, p: dict) -> Formula:
    n = p["length"]
    weights = [math.sin(2 * math.pi * k / n) / n for k in range(n)]
    return line(q.weighted(q.window("close", n), weights[::-1]))


@indicator("RankCorrelationIndex")
def rank_correlation(q: Dialect, p: dict) -> Formula:
    """Correlation of time with tie-averaged ranks of the closes."""
    n = p["length"]
    below, same = q.count_where("w", "y", "y < z"), q.count_where("w", "y", "y = z")
    ranks = q.map("w", "z", f"{q.number(0.5)} + {below} + {q.number(0.5)} * {same}")
    middle = q.number((n + 1) / 2)
    times = [k - (n + 1) / 2 for k in range(1, n + 1)]
    above = q.weighted("r", times)
    spread = q.add_up(q.map("r", "z", f"(z - {middle}) * (z - {middle})"))
    norm = q.number(sum(t * t for t in times))
    value = f"CASE WHEN spread = 0 THEN {q.number(0)} ELSE {q.divide(above, f'sqrt(spread * {norm})')} END"
    return line(f"CASE WHEN spread IS NOT NULL THEN {value} END", ("w", q.window("close", n)), ("r", ranks), ("spread", spread))


@indicator("RelativeVigorIndex")
def relative_vigor(q: Dialect, p: dict) -> Formula:
    """Weights 1, 2, 2, 1 on the oldest four of each window; over flat bars the mean move itself."""

    def oldest(x: str, n: int) -> str:
        first = " + ".join(f"{k} * {q.lag(x, n - 1 - j)}" for j, k in enumerate((1, 2, 2)))
        return f"({first} + {q.forms(x, q.lag(x, n - 4))}) / 6"

    n, whole = p["averageLength"], q.both("open", "high", "low", "close")
    steps = [
        ("a", f"CASE WHEN {whole} THEN close - open END"), ("b", f"CASE WHEN {whole} THEN high - low END"), ("above", oldest("a", n)), ("below", oldest("b", n)),
        ("rvi", "CASE WHEN below = 0 THEN above ELSE above / below END"),
    ]
    return Formula({"rvi": "rvi", "signal": oldest("rvi", p["signalLength"])}, steps)


@indicator("MarketMeannessIndex")
def market_meanness(q: Dialect, p: dict) -> Formula:
    """Turns among the steps of a window of closes there were: a step counts if the one before moved and it goes another way."""
    n = p["length"]
    steps = [
        ("ok", q.flag(q.both("close"))), ("s", f"CASE WHEN ok = 1 THEN sign(close - {q.before('close')}) END"), ("t", q.before("s")),
        ("moved", "CASE WHEN s <> 0 THEN 1 ELSE 0 END"), ("turned", "CASE WHEN t <> 0 AND s <> t THEN 1 ELSE 0 END"),
    ]
    changes = q.among("sum(moved)", "ok", n - 1)
    turns = q.among("sum(turned)", "ok", n - 2) if n > 2 else "0"
    steps += [("changes", f"CAST({changes} AS DOUBLE)"), ("turns", f"CAST({turns} AS DOUBLE)")]
    return line(f"CASE WHEN ok = 1 AND {q.among('count(close)', 'ok', n)} = {n} THEN coalesce(100 * ({q.divide('turns', 'changes')}), {q.number(0)}) END", *steps)


@indicator("HurstExponent")
def hurst(q: Dialect, p: dict) -> Formula:
    """Range of the summed deviations over their spread, in logs; the sums are differences of one running sum."""
    n = p["length"]
    if n == 1:
        return line("CAST(NULL AS DOUBLE)")
    steps = [
        ("x", f"close - {q.first('close')}"), ("run", q.cumulative("x")), ("before", f"coalesce({q.lag('run', n)}, {q.number(0)})"),
        ("m", f"CASE WHEN count(close) {q.over(n)} = {n} THEN (run - before) / {n} END"), ("s", q.deviation("close", n)),
        ("runs", q.window("run", n)), ("d", q.map_at("runs", "z", "k", "z - before - k * m")),
    ]
    reach = f"{q.largest('d')} - {q.smallest('d')}"
    return line(f"CASE WHEN s > 0 AND {reach} > 0 THEN ln(({reach}) / s) / {q.number(math.log(n))} END", *steps)
