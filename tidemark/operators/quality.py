"""Checks of bars: counts, coverage, values that can't be, missing sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name`` and number of rows ``n`` of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def tally(rows: DataFrame, key: str, bad: Column) -> DataFrame:
    """Number ``n`` of rows of each key for which the condition holds; unknown counts as not."""
    return rows.groupBy(key).agg(F.sum(F.when(bad, 1).otherwise(0)).alias("n"))


def nonpositive(rows: DataFrame, key: str, value: str, *, shown: int = 5) -> DataFrame:
    """Keys with values at or below zero: their number and the first times, ``shown`` at most."""
    bad = rows.where(F.col(value) <= 0)
    ranked = bad.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("time")))
    first = F.sort_array(F.collect_list(F.when(F.col("_k") <= shown, F.col("time"))))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), first.alias("first_bad"))


def coverage(bars: DataFrame, key: str, thin: Column) -> DataFrame:
    """Bars, span, share of thin bars in percent and missing closes of each key."""
    share = F.avg(F.when(thin, 1.0).otherwise(0.0)) * 100
    return bars.groupBy(key).agg(F.count("*").alias("bars"), F.min("time").alias("first_bar"), F.max("time").alias("last_bar"), F.round(share, 2).alias("thin_pct"), F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).alias("null_close"))


def gaps(bars: DataFrame, key: str, calendar: DataFrame, most: int) -> DataFrame:
    """Bars that follow over ``most`` sessions without one; ``calendar`` as ``universe.trading_days`` gives it."""
    numbered = bars.withColumn("_day", F.to_date("time")).join(calendar.select(F.col("date").alias("_day"), "k"), "_day")
    missing = F.col("k") - F.lag("k").over(Window.partitionBy(key).orderBy("time")) - 1
    return numbered.withColumn("missing", missing.cast("long")).where(F.col("missing") > most).select(key, "time", "missing")
