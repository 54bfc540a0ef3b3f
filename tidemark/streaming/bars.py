"""Streaming bars: tumbling windows with a watermark; a bucket is emitted once it can't change.

The watermark follows the largest event time seen, not the clock.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.rollup import Policy


def stream_ohlcv(ticks: DataFrame, *, width: str = "1 hour", late: str = "2 hours", key: str = "symbol_id", tie: str | None = None) -> DataFrame:
    """``ticks`` is a stream of ``time`` (timestamp), ``price``, ``size`` and the key; of equal times ``tie`` tells the order."""
    order = F.struct("time", tie) if tie else F.col("time")
    rows = ticks.withWatermark("time", late).groupBy(F.window("time", width), key)
    bars = rows.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("bar_count"))
    return bars.select(key, F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume", "bar_count")


def stream_vwap(ticks: DataFrame, *, late: str = "1 day", key: str = "symbol_id") -> DataFrame:
    """Each day's mean price by size, once the day can't change."""
    rows = ticks.withWatermark("time", late).groupBy(F.window("time", "1 day"), key)
    out = rows.agg((F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("vwap"), F.sum("size").alias("total_volume"))
    return out.select(key, F.col("window.start").alias("bucket"), "vwap", "total_volume")


def stream_distinct(ticks: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key to come; another one counts as new once the key is older than the watermark."""
    return ticks.withWatermark("time", late).dropDuplicatesWithinWatermark(keys)


def follow(ticks: DataFrame, policy: Policy, clock: Callable[[int], datetime.datetime]) -> DataStreamWriter:
    """Stores each batch of a stream and refreshes the policy's rollup at the time the clock gives for its number.

    A batch that is run again after a failure replaces what it stored.
    """

    def step(batch: DataFrame, number: int) -> None:
        policy.arrive(batch, number)
        policy.refresh(clock(number))

    return ticks.writeStream.foreachBatch(step)
