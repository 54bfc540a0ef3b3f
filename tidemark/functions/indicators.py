"""Rolling indicators as columns. Windows are given once, so Spark shares one shuffle and sort.

Partial forms give a value from the first row; strict forms are null until the
window is full of non-null values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, time: str = "time") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def sma_partial(value: Column, w: WindowSpec, n: int) -> Column:
    return F.avg(value).over(w.rowsBetween(1 - n, 0))


def stddev_partial(value: Column, w: WindowSpec, n: int) -> Column:
    return F.stddev_samp(value).over(w.rowsBetween(1 - n, 0))


def sma(value: Column, w: WindowSpec, n: int) -> Column:
    if n < 1:
        raise ValueError("the window must be 1 or more")
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def log_return(close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.when((close > 0) & (before > 0), F.log(close / before))


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def position(fast: Column, slow: Column) -> Column:
    """1 above, 0 otherwise, null while either average is."""
    return F.when(fast.isNull() | slow.isNull(), F.lit(None).cast("double")).when(fast > slow, 1.0).otherwise(0.0)


def crossings(fast: Column, slow: Column, w: WindowSpec, mode: str = "strict") -> tuple[Column, Column]:
    """Entry and exit. ``strict`` needs both averages on this and the previous row; ``compat`` takes warm-up as not above."""
    if mode == "compat":
        above = F.coalesce(fast > slow, F.lit(False))
        before = F.coalesce(F.lag(above).over(w), F.lit(False))
        valid = fast.isNotNull() & slow.isNotNull()
        return above & ~before & valid, ~above & before & valid
    f, s = F.lag(fast).over(w), F.lag(slow).over(w)
    return F.coalesce((fast > slow) & (f <= s), F.lit(False)), F.coalesce((fast < slow) & (f >= s), F.lit(False))


def drawdown(value: Column, w: WindowSpec) -> Column:
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (value - peak) / F.nullif(peak, F.lit(0.0))


def period_return(value: Column, w: WindowSpec) -> Column:
    before = F.lag(value).over(w)
    return value / F.nullif(before, F.lit(0.0)) - 1


ANNUAL = math.sqrt(252)
