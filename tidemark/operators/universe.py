"""Point-in-time memberships, half-open [entry_date, exit_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def member_on(day: Column, *, compat: bool = False) -> Column:
    """Whether the membership holds on ``day``; ``compat`` counts the exit date too."""
    ends = F.col("exit_date") >= day if compat else F.col("exit_date") > day
    return (F.col("entry_date") <= day) & (F.col("exit_date").isNull() | ends)


def daily_counts(members: DataFrame, days: DataFrame) -> DataFrame:
    """Members of each index on each of the distinct ``day`` of ``days``, where there are any: running sums of entries less exits."""
    valid = members.where("entry_date is not null and (exit_date is null or exit_date > entry_date)")
    entries = valid.select("index_code", F.col("entry_date").alias("day"), F.lit(1).alias("step"), F.lit(False).alias("asked"))
    exits = valid.where("exit_date is not null").select("index_code", F.col("exit_date").alias("day"), F.lit(-1).alias("step"), F.lit(False).alias("asked"))
    calendar = days.select("day").distinct().crossJoin(valid.select("index_code").distinct()).select("index_code", "day", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    daily = entries.unionByName(exits).unionByName(calendar).groupBy("index_code", "day").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    running = daily.withColumn("members", F.sum("step").over(Window.partitionBy("index_code").orderBy("day")))
    return running.where("asked and members > 0").select("day", "index_code", "members")


def overlapping(members: DataFrame, start: str, end: str) -> DataFrame:
    return members.where((F.col("entry_date") <= F.lit(end).cast("date")) & (F.col("exit_date").isNull() | (F.col("exit_date") > F.lit(start).cast("date"))))


def clip(bars: DataFrame, members: DataFrame, key: str, *, compat: bool = False) -> DataFrame:
    """Bars inside one of their symbol's windows, once however many hold them."""
    windows = members.select(F.col(key).alias("_key"), "entry_date", "exit_date")
    day = F.to_date("time")
    return bars.join(windows, (F.col(key) == F.col("_key")) & member_on(day, compat=compat), "left_semi")


def intervals(changes: DataFrame) -> DataFrame:
    """``ticker, action, effective_date`` to windows: each ADD ends at the next REMOVE; an ADD while a member opens nothing."""
    w = Window.partitionBy("ticker").orderBy("effective_date", F.col("action").desc())
    seen = changes.withColumn("before", F.lag("action").over(w))
    turns = seen.where(F.col("before").isNull() & (F.col("action") == "ADD") | (F.col("before") != F.col("action")))
    ended = turns.withColumn("exit_date", F.lead("effective_date").over(w))
    return ended.where((F.col("action") == "ADD") & (F.col("exit_date").isNull() | (F.col("exit_date") > F.col("effective_date")))).select("ticker", F.col("effective_date").alias("entry_date"), "exit_date")


def sync(live: DataFrame, current: DataFrame, key: str, *, most_exits: int = 20) -> tuple[DataFrame, DataFrame]:
    """New and left members by comparison with a snapshot; over ``most_exits`` leavers means a bad snapshot, and none leaves."""
    new = live.select(key).distinct().join(current.select(key), key, "left_anti")
    gone = current.select(key).distinct().join(live.select(key), key, "left_anti")
    few = gone.agg((F.count("*") <= most_exits).alias("few"))
    return new, gone.crossJoin(F.broadcast(few)).where("few").drop("few")


def at_date(members: DataFrame, index: str, day: str) -> DataFrame:
    """Symbols that are members of the index on a day."""
    return members.where((F.col("index_code") == index) & member_on(F.lit(day).cast("date"))).select("symbol_id")


def trading_days(days: DataFrame) -> DataFrame:
    """Each date from the first to the last trading ``day`` with the number ``k`` of the last trading day up to it. A calendar is bounded by its years."""
    numbered = days.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day"))).withColumn("next", F.lead("day").over(Window.orderBy("day")))
    return numbered.select("day", "k", F.explode(F.sequence("day", F.coalesce(F.date_sub("next", 1), F.col("day")))).alias("date"))


def weekdays(spark, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Mondays to Fridays from start to end, without those in ``holidays`` (``day``)."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    return one if holidays is None else one.join(holidays.select("day"), "day", "left_anti")


def shifted(dates: DataFrame, column: str, calendar: DataFrame, n: int, name: str) -> DataFrame:
    """Add the trading day ``n`` before the last one up to ``column``; null where the calendar doesn't reach."""
    own = calendar.select(F.col("date").alias(column), (F.col("k") - n).alias("_k"))
    days = calendar.select(F.col("k").alias("_k"), F.col("day").alias(name)).distinct()
    return dates.join(own, column, "left").join(days, "_k", "left").drop("_k")


def load(bars: DataFrame, members: DataFrame, calendar: DataFrame, key: str, start: str, end: str, warmup: int) -> DataFrame:
    """Bars of members whose window overlaps [start, end], from ``warmup`` trading days before the later of start and entry, up to the earlier of end and exit.

    Windows of one symbol that overlap give a bar once.
    """
    begin = F.lit(start).cast("date")
    held = overlapping(members, start, end).select(F.col(key).alias("_key"), "entry_date", "exit_date").withColumn("_first", F.greatest("entry_date", begin))
    spans = shifted(held, "_first", calendar, warmup, "_from").withColumn("_from", F.coalesce("_from", "_first"))
    day = F.to_date("time")
    inside = (F.col(key) == F.col("_key")) & (day >= F.col("_from")) & (day <= F.lit(end).cast("date")) & (F.col("exit_date").isNull() | (day < F.col("exit_date")))
    return bars.join(spans, inside, "left_semi")
