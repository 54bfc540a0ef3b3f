"""Bars from ticks or finer bars."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written
from tidemark.sources.stored import Stored, values


def ohlcv(rows: DataFrame, key: str, bucket: Column, *, price: str = "price", size: str = "size", tie: str | None = None) -> DataFrame:
    """First, highest, lowest and last price of each bucket by time, total size and count."""
    order = F.struct("time", tie) if tie else F.col("time")
    return rows.groupBy(key, bucket.alias("bucket")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume"), F.count("*").alias("bar_count"))


def coarser(bars: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Bars of a larger ``bucket`` from finer ones of ``ohlcv``."""
    return bars.groupBy(key, bucket.alias("bucket")).agg(F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume"), F.sum("bar_count").alias("bar_count"))


def vwap(rows: DataFrame, key: str, bucket: Column, *, price: str = "price", size: str = "size") -> DataFrame:
    total = F.sum(size)
    return rows.groupBy(key, bucket.alias("bucket")).agg((F.sum(F.col(price) * F.col(size)) / F.nullif(total, F.lit(0))).alias("vwap"), total.alias("total_volume"))


def refresh(target: DataFrame, source: DataFrame, start: str, end: str, build) -> DataFrame:
    """Buckets of ``target`` outside [start, end), and those built anew from ``source`` inside."""
    inside = (F.col("bucket") >= F.lit(start).cast("timestamp_ntz")) & (F.col("bucket") < F.lit(end).cast("timestamp_ntz"))
    fresh = build(source.where((F.col("time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("time") < F.lit(end).cast("timestamp_ntz"))))
    return target.where(~inside).unionByName(fresh)


class Policy:
    """A stored rollup that follows its source: at a refresh, changed buckets between two offsets from the clock are built anew.

    ``arrive`` stores rows and notes the buckets they change; ``refresh``
    builds the noted buckets of [now - ``start``, now - ``end``), whole buckets
    only, from all rows stored, and forgets the notes. Notes outside stay
    until a window, or ``repair``, covers them: rows that come later than
    ``start`` don't change the rollup by themselves. ``build`` gives rows with
    the key and ``bucket`` from source rows with a ``bucket``; tables are
    partitioned by the day of the bucket.
    """

    def __init__(self, source: Stored, notes: Stored, target: Stored, key: str, build: Callable[[DataFrame], DataFrame], *, width: int, start: int, end: int):
        self.source, self.notes, self.target, self.key, self.build = source, notes, target, key, build
        self.width, self.start, self.end = width, start, end

    def arrive(self, rows: DataFrame, number: int) -> None:
        """Stores load ``number``; the same load stored again replaces itself."""
        seconds = F.unix_seconds(F.col("time").cast("timestamp"))
        bucket = F.timestamp_seconds(F.floor(seconds / self.width) * self.width).cast("timestamp_ntz")
        stamped = written(rows.withColumns({"bucket": bucket, "load": F.lit(number)}).withColumn("part", F.concat(F.to_date("bucket").cast("string"), F.lit(f".{number:08d}"))), "load")
        self.source.write(stamped)
        self.notes.write(stamped.select(self.key, "bucket", "part", F.lit(True).alias("open")).distinct())

    def refresh(self, now: datetime.datetime) -> None:
        """Builds what has changed in the policy's window at ``now``."""
        day = datetime.datetime(1970, 1, 1)
        since, until = (day + datetime.timedelta(seconds=(now - day).total_seconds() // 1 - offset) for offset in (self.start, self.end))
        # Whole buckets only: the window shrinks to bucket bounds.
        lead = -(since - day).total_seconds() % self.width
        self.repair(since + datetime.timedelta(seconds=lead), until - datetime.timedelta(seconds=(until - day).total_seconds() % self.width))

    def repair(self, since: datetime.datetime, until: datetime.datetime) -> None:
        """Builds what has changed in [since, until)."""
        notes = self.notes.read(self._parts(self.notes, since, until))
        inside = (F.col("bucket") >= F.lit(since)) & (F.col("bucket") < F.lit(until)) & F.col("open")
        due = written(notes.where(inside).select(self.key, "bucket").distinct(), "due")
        days = values(due.withColumn("day", F.to_date("bucket")), "day")
        if not days:
            return
        rows = self.source.read(self._parts(self.source, min(days), max(days)))
        fresh = self.build(rows.join(due, [self.key, "bucket"], "left_semi")).withColumn("day", F.to_date("bucket"))
        kept = self.target.read(days).join(due, [self.key, "bucket"], "left_anti")
        self.target.write(kept.unionByName(fresh.select(*kept.columns)))
        self.notes.write(notes.withColumn("open", ~inside & F.col("open")))

    @staticmethod
    def _parts(table: Stored, since: datetime.date, until: datetime.date) -> list[str]:
        """Partitions, named by day and load, of the days from ``since`` to ``until``."""
        return [p for p in table.current() if f"{since:%Y-%m-%d}" <= p.split(".")[0] <= f"{until:%Y-%m-%d}"]
