"""Window frames over a series: full trailing windows, changes, and exponentially weighted means. All run inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

try:  # not part of the public interface: a later Spark may do without
    from pyspark.sql.internal import InternalFunction

    weighted_mean = InternalFunction.ewm
except (ImportError, AttributeError):
    weighted_mean = None


@dataclass(frozen=True)
class Names:
    """Column names of a bar table; key is None for a table of one instrument."""

    key: str | None = "ticker"
    time: str = "timestamp"
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"
    block: str | None = None

    def series(self, *more: str) -> WindowSpec:
        """One instrument's bars in time order, or those of one of its blocks. Every frame of a stage shares it, so a stage costs one exchange and one sort."""
        keys = [*[k for k in (self.key, self.block) if k], *more]
        return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(self.time)


ARCHIVE = Names()
ANALYSIS = Names(key=None, time="Date", open="Open", high="High", low="Low", close="Close", volume="Volume")


def trailing(series: WindowSpec, rows: int) -> WindowSpec:
    return series.rowsBetween(-(rows - 1), 0)


def so_far(series: WindowSpec) -> WindowSpec:
    return series.rowsBetween(Window.unboundedPreceding, 0)


def full(aggregate: Callable[[Column], Column], value: Column, series: WindowSpec, rows: int) -> Column:
    """aggregate over the last `rows` rows if all of them have a value, else null."""
    frame = trailing(series, rows)
    return F.when(F.count(value).over(frame) == rows, aggregate(value).over(frame))


Ratio = Callable[[Column, Column], Column]


def floating_ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: infinite, or not a number, where b is 0."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(F.try_divide(a, b))


def change(value: Column, series: WindowSpec, rows: int = 1, ratio: Ratio = F.try_divide) -> Column:
    """value / value `rows` earlier - 1; null where either is missing or, with the plain ratio, the earlier is 0."""
    return ratio(value, F.lag(value, rows).over(series)) - 1


def ewm(value: Column, alpha: float, series: WindowSpec, min_periods: int = 1) -> Column:
    """The recursive mean y = (1 - alpha) y + alpha x started at the first value, null before min_periods values.

    Spark's weighted mean E divides by the sum of weights; with n values so far the recursion is (1 - d) E + d x₀,
    d = (1 - alpha)ⁿ; missing values are passed over. A series that has been constant so far is returned exactly, so differences of means of it are exactly 0.
    """
    if weighted_mean is None:
        return ewm_by_fold(value, alpha, series, min_periods)
    frame = so_far(series)
    n = F.count(value).over(frame)
    first = F.first(value, ignorenulls=True).over(frame)
    fade = F.pow(F.lit(1.0 - alpha), n)
    flat = F.min(value).over(frame) == F.max(value).over(frame)
    mean = F.when(flat, first).otherwise((1 - fade) * weighted_mean(value, alpha, True).over(series) + fade * first)
    return F.when(n >= min_periods, mean)


def fold_depth(alpha: float) -> int:
    """Values beyond which weights vanish."""
    return math.ceil(41 / -math.log(1 - alpha))


def ewm_by_fold(value: Column, alpha: float, series: WindowSpec, min_periods: int = 1, depth: int | None = None) -> Column:
    """ewm() from public functions only: a fold over the last `depth` values, beyond which weights vanish. Slower."""
    depth = depth or fold_depth(alpha)
    recent = F.collect_list(value).over(trailing(series, depth))
    step = lambda y, x: F.when(y.isNull() | (y == x), x).otherwise((1 - alpha) * y + alpha * x)
    return F.when(F.count(value).over(so_far(series)) >= min_periods, F.aggregate(recent, F.lit(None).cast("double"), step))
