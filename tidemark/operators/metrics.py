"""Performance statistics of equity curves and returns, one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import drawdown, period_return

ZERO = 0.0


def cagr(value: Column, time: Column) -> Column:
    first, last = F.min_by(value, time), F.max_by(value, time)
    days = F.datediff(F.max(time), F.min(time))
    return F.when((F.count(value) >= 2) & (first > 0) & (days > 0), F.pow(last / first, F.lit(365.25) / F.nullif(days, F.lit(0))) - 1)


def sharpe(r: Column, rf: float = 0.0, periods: int = 252) -> Column:
    spread = F.nullif(F.stddev_samp(r), F.lit(ZERO))
    return F.when(F.count(r) >= 2, (F.avg(r) - rf / periods) / spread * F.sqrt(F.lit(float(periods))))


def sortino(r: Column, rf: float = 0.0, periods: int = 252) -> Column:
    excess = r - rf / periods
    below = F.when(excess < 0, excess)
    spread = F.nullif(F.stddev_samp(below), F.lit(ZERO))
    return F.when(F.count(r) < 2, None).when(F.count(below) == 0, F.lit(float("inf"))).otherwise(F.avg(excess) / spread * F.sqrt(F.lit(float(periods))))


def win_rate(r: Column) -> Column:
    return F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0))


def profit_factor(r: Column) -> Column:
    gain, loss = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(ZERO)), F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(ZERO)))
    return F.when(loss > 0, gain / F.nullif(loss, F.lit(ZERO))).when(gain > 0, F.lit(float("inf")))


def with_returns(curve: DataFrame, key: str, value: str = "value") -> DataFrame:
    w = Window.partitionBy(key).orderBy("time")
    return curve.withColumn("r", period_return(F.col(value), w)).withColumn("drawdown", drawdown(F.col(value), w))


def summary(curve: DataFrame, key: str, *, value: str = "value", trades: DataFrame | None = None, rf: float = 0.043, periods: int = 252) -> DataFrame:
    """One row for each run: span, return, growth, risk and ratios to four places; with ``trades`` (``net_return``) their number and statistics, null for a run without any."""
    v, t = F.col(value), F.col("time")
    deepest = F.abs(F.min("drawdown"))
    growth = cagr(v, t)
    out = with_returns(curve, key, value).groupBy(key).agg(
        F.to_date(F.min(t)).alias("start_date"), F.to_date(F.max(t)).alias("end_date"),
        (F.max_by(v, t) / F.nullif(F.min_by(v, t), F.lit(ZERO)) - 1).alias("total_return"), growth.alias("cagr"), deepest.alias("max_drawdown"),
        sharpe(F.col("r"), rf, periods).alias("sharpe"), sortino(F.col("r"), rf, periods).alias("sortino"), (growth / F.nullif(deepest, F.lit(ZERO))).alias("calmar"),
        F.count("*").alias("n"))
    found = out.select(key, "start_date", "end_date", *[F.round(c, 4).alias(c) for c in ("total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar")], F.lit(rf).alias("risk_free_rate"), "n")
    if trades is None:
        return found
    r = F.col("net_return")
    closed = trades.groupBy(key).agg(F.count(r).alias("num_trades"), F.round(win_rate(r), 4).alias("win_rate"), F.round(profit_factor(r), 4).alias("profit_factor"), F.round(F.avg(r), 6).alias("avg_trade"))
    return found.join(closed, key, "left")


def against_benchmark(strategy: DataFrame, bench: DataFrame, key: str, *, rf: float = 0.0, periods: int = 252, full: bool = False) -> DataFrame:
    """Alpha, beta, tracking error and information ratio over common times; both have ``time, r``.

    ``full`` adds ``excess_return``, the difference of yearly growth, and both
    Sharpe ratios. Growth runs from the end of the first common return, which
    isn't part of it.
    """
    b = bench.select("time", F.col("r").alias("b"))
    both = strategy.select(key, "time", F.col("r").alias("s")).join(b, "time").where("s is not null and b is not null")
    active = F.col("s") - F.col("b")
    beta = F.covar_samp("s", "b") / F.nullif(F.var_samp("b"), F.lit(ZERO))
    daily = rf / periods
    found = {
        "beta": beta, "alpha": ((F.avg("s") - daily) - beta * (F.avg("b") - daily)) * periods, "tracking_error": F.stddev_samp(active) * F.sqrt(F.lit(float(periods))),
        "information_ratio": F.avg(active) / F.nullif(F.stddev_samp(active), F.lit(ZERO)) * F.sqrt(F.lit(float(periods)))}
    if full:
        found |= {"excess_return": _growth("s") - _growth("b"), "strategy_sharpe": sharpe(F.col("s"), rf, periods), "benchmark_sharpe": sharpe(F.col("b"), rf, periods)}
    return both.groupBy(key).agg(*(F.round(value, 4).alias(name) for name, value in found.items()), F.count("*").alias("n"))


def _growth(r: str) -> Column:
    """Yearly growth of a curve of returns, whose first point is the end of the first return."""
    days = F.datediff(F.max("time"), F.min("time"))
    whole = F.product(1 + F.col(r)) / F.nullif(1 + F.min_by(r, "time"), F.lit(ZERO))
    return F.when((F.count("*") >= 2) & (days > 0) & (F.min_by(r, "time") > -1), F.pow(whole, F.lit(365.25) / F.nullif(days, F.lit(0))) - 1)


def histogram(rows: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """``bin, low, n`` of each key: equal bins from its least value to its largest, which lies in the last one; empty bins count 0.

    A key with one value only has bins from half below it to half above. Nulls
    and values that are no number take no part.
    """
    v = F.col(value)
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(key, v.alias("_v"))
    ends = known.groupBy(key).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    flat = F.col("low") == F.col("high")
    ends = ends.select(key, F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.lit(1.0)).otherwise(F.col("high") - F.col("low")).alias("width"))
    place = F.least(F.floor((F.col("_v") - F.col("low")) / F.col("width") * bins), F.lit(bins - 1)).cast("int")
    counts = known.join(ends, key).groupBy(key, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select(key, "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    found = grid.join(counts, [key, "bin"], "left")
    return found.select(key, "bin", (F.col("low") + F.col("width") * F.col("bin") / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))
