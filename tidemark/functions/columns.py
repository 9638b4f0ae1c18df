"""The kernels as Column helpers, for plans of one's own.

``over`` names the series; every helper takes it last, so that any number of them share
one exchange and one sort. ``n`` is a number of bars. A value is there once n are, all
of them with a value, as with the indicators; ``partial`` variants say otherwise.

    w = over("symbol", "time")
    df.select("*", sma("close", 20, w).alias("m"), highest("high", 20, w).alias("top"))
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

__all__ = [
    "over", "known", "shifted", "before", "total", "partial_total", "sma", "highest", "lowest", "deviation", "mean_deviation", "median", "wma", "weighted",
    "slope", "endpoint", "forecast", "r_squared", "standard_error", "efficiency_ratio", "commodity_channel_index", "true_range", "is_zero", "platform_decimal",
]

X = Column | str


def over(series: str | list[str] = "symbol", time: str = "time") -> WindowSpec:
    """Bars of a series in order of time; ``series`` are one or more columns."""
    return W.partitionBy(series).orderBy(time)


def _col(x: X) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _last(n: int, w: WindowSpec) -> WindowSpec:
    if n < 1:
        raise ValueError(f"a window has at least one bar, not {n}")
    return w.rowsBetween(1 - n, 0)


def known(x: X) -> Column:
    """``x`` where it is a finite number, else null."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _whole(value: Column, x: X, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(_col(x)).over(_last(n, w)) == n, value)


def shifted(x: X, k: int, w: WindowSpec) -> Column:
    """The value k bars before."""
    return F.lag(_col(x), k).over(w) if k else _col(x)


def before(x: X, w: WindowSpec) -> Column:
    """The last value there was on an earlier bar."""
    return F.last(_col(x), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))


def total(x: X, n: int, w: WindowSpec) -> Column:
    return _whole(F.sum(_col(x)).over(_last(n, w)), x, n, w)


def partial_total(x: X, n: int, w: WindowSpec) -> Column:
    """The sum of what there is in the last n bars."""
    return F.sum(_col(x)).over(_last(n, w))


def sma(x: X, n: int, w: WindowSpec) -> Column:
    return _whole(F.avg(_col(x)).over(_last(n, w)), x, n, w)


def highest(x: X, n: int, w: WindowSpec) -> Column:
    return _whole(F.max(_col(x)).over(_last(n, w)), x, n, w)


def lowest(x: X, n: int, w: WindowSpec) -> Column:
    return _whole(F.min(_col(x)).over(_last(n, w)), x, n, w)


def deviation(x: X, n: int, w: WindowSpec, sample: bool = False) -> Column:
    """Standard deviation of the population, or of a sample; exactly zero on a flat window."""
    flat = F.max(_col(x)).over(_last(n, w)) == F.min(_col(x)).over(_last(n, w))
    spread = F.stddev_samp if sample else F.stddev_pop
    return _whole(F.when(flat, F.lit(0.0)).otherwise(spread(_col(x)).over(_last(n, w))), x, n, w)


def _items(x: X, n: int, w: WindowSpec) -> Column:
    return _whole(F.collect_list(_col(x)).over(_last(n, w)), x, n, w)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, y: a + y)


def mean_deviation(x: X, n: int, w: WindowSpec) -> Column:
    """Mean distance from the mean."""
    mean = F.avg(_col(x)).over(_last(n, w))
    return _sum(F.transform(_items(x, n, w), lambda y: F.abs(y - mean))) / n


def median(x: X, n: int, w: WindowSpec) -> Column:
    """The middle value, or the mean of the two in the middle."""
    held = F.array_sort(_items(x, n, w))
    return held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2


def weighted(x: X, weights: list[float], w: WindowSpec) -> Column:
    """The sum of the last values times ``weights``, oldest first."""
    terms = F.zip_with(_items(x, len(weights), w), F.array(*[F.lit(float(k)) for k in weights]), lambda a, b: a * b)
    return _sum(terms)


def wma(x: X, n: int, w: WindowSpec) -> Column:
    """The mean with weights 1 to n, the newest the heaviest."""
    return weighted(x, [float(k) for k in range(1, n + 1)], w) / (n * (n + 1) / 2)


def _line(x: X, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """Mean and slope of the last n values against their places, 0 to n - 1."""
    mean = sma(x, n, w)
    above = weighted(x, [k - (n - 1) / 2 for k in range(n)], w)
    return mean, above / F.lit((n**3 - n) / 12 if n > 1 else None)


def slope(x: X, n: int, w: WindowSpec) -> Column:
    """Of the least-squares line; none for one bar."""
    return _line(x, n, w)[1]


def endpoint(x: X, n: int, w: WindowSpec) -> Column:
    """The least-squares line at the last bar."""
    mean, tilt = _line(x, n, w)
    return mean + tilt * ((n - 1) / 2) if n > 1 else known(x)


def forecast(x: X, n: int, w: WindowSpec) -> Column:
    """The least-squares line one bar on."""
    mean, tilt = _line(x, n, w)
    return mean + tilt * ((n + 1) / 2)


def r_squared(x: X, n: int, w: WindowSpec) -> Column:
    """The share of the variance that the line explains; 0 on a flat window."""
    spread = deviation(x, n, w)
    share = slope(x, n, w) ** 2 * ((n * n - 1) / 12)
    part = share / F.nullif(spread * spread, F.lit(0.0))
    return F.when(spread == 0, F.lit(0.0)).when(part > 1, F.lit(1.0)).otherwise(part)


def standard_error(x: X, n: int, w: WindowSpec) -> Column:
    """Of the least-squares line; 0 for two bars and fewer."""
    if n <= 2:
        return _whole(F.lit(0.0), x, n, w)
    left = (deviation(x, n, w) ** 2 - slope(x, n, w) ** 2 * ((n * n - 1) / 12)) * (n / (n - 2))
    return F.sqrt(F.when(left < 0, F.lit(0.0)).otherwise(left))


def efficiency_ratio(x: X, n: int, w: WindowSpec) -> Column:
    """The way from the first to the last of n values over the path between; 0 where nothing moved."""
    held = _items(x, n, w)
    steps = F.zip_with(F.slice(held, 1, max(n - 1, 1)), F.slice(held, 2, max(n - 1, 1)), lambda a, b: F.abs(b - a))
    path = F.aggregate(steps, F.lit(0.0), lambda a, y: a + F.coalesce(y, F.lit(0.0)))
    return F.when(path == 0, F.lit(0.0)).otherwise(F.abs(held[n - 1] - held[0]) / F.nullif(path, F.lit(0.0)))


def commodity_channel_index(x: X, n: int, w: WindowSpec) -> Column:
    """Distance from the mean over 0.015 mean deviations; none on a flat window."""
    spread = mean_deviation(x, n, w)
    return (_col(x) - sma(x, n, w)) / (F.lit(0.015) * F.nullif(spread, F.lit(0.0)))


def true_range(high: X, low: X, close: X, w: WindowSpec) -> Column:
    """Reach of a bar including the close before it; the first bar's is its own range."""
    last = shifted(close, 1, w)
    reach = F.greatest(_col(high), F.coalesce(last, _col(high))) - F.least(_col(low), F.coalesce(last, _col(low)))
    return F.when(_col(high).isNotNull() & _col(low).isNotNull(), reach)


def is_zero(x: X, scale: X | float) -> Column:
    """Whether a value is nothing beside ``scale``: at most 1e-12 of it."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else _col(scale)
    return F.abs(_col(x)) <= F.abs(scale) * F.lit(1e-12)


def platform_decimal(x: X) -> Column:
    """Values under 1e-27 at multiples of 1e-28, as a decimal type of 28 digits would have them."""
    x = _col(x)
    return F.when(F.abs(x) < F.lit(1e-27), F.rint(x / F.lit(1e-28)) * F.lit(1e-28)).otherwise(x)
