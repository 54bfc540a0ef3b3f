"""Idempotent writes as set operations; each returns the new state of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.shared import written
from tidemark.sources.stored import Stored, values


def keep_last(rows: DataFrame, keys: list, order: list) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], *, arrival: str | None = None, needed: str = "open") -> DataFrame:
    """Rows whose key is absent are added, of each key the first by ``arrival``; rows without ``needed`` are skipped.

    Without ``arrival`` a key that comes twice is an error: which row was first isn't known.
    """
    fresh = new.where(F.col(needed).isNotNull())
    if arrival is None:
        of_key = Window.partitionBy(*keys)
        once = F.when(F.count("*").over(of_key) > 1, F.raise_error(F.lit("a key comes twice: name the order of arrival"))).otherwise(F.lit(1))
        first = fresh.withColumn("_k", once.cast("int")).where("_k = 1").drop("_k")
    else:
        first = keep_last(fresh, keys, [F.col(arrival)])
    return existing.unionByName(first.select(*existing.columns).join(existing.select(*keys), keys, "left_anti"))


def insert_first(store: Stored, new: DataFrame, keys: list[str], *, arrival: str, needed: str = "open") -> None:
    """``upsert_ignore`` into a stored table: what an earlier write brought stays, then the first of this one.

    Reads and rewrites only partitions that get new rows. A key with a null is
    never there, as for a unique constraint.
    """
    columns = store.schema.names
    first = written(keep_last(new.where(F.col(needed).isNotNull()), keys, [F.col(arrival)]).select(*columns), "arrived")
    held = store.read(values(first, store.part))
    fresh = written(first.join(held.select(*keys), keys, "left_anti"), "fresh")
    touched = values(fresh, store.part)
    if touched:
        store.write(store.read(touched).unionByName(fresh))


def upsert_merge(existing: DataFrame, new: DataFrame, keys: list[str], *, overwrite: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """``overwrite`` columns come from the new row where there is one; ``fill`` columns are replaced by non-nulls only."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*overwrite, *fill]], F.lit(True).alias("_new"))
    both = existing.join(n, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite], *[F.coalesce(f"_{c}", c).alias(c) for c in fill])


def close_open(existing: DataFrame, closures: DataFrame, keys: list[str]) -> DataFrame:
    """Set ``exit_date`` of open windows that a closure names."""
    c = closures.select(*keys, F.col("exit_date").alias("_exit"))
    return existing.join(c, keys, "left").withColumn("exit_date", F.coalesce("exit_date", "_exit")).drop("_exit")


def conform(rows: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns and types of ``schema``."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def export(rows: DataFrame, path: str, parts: list[str], order: list[str]) -> None:
    """Partitioned Parquet; only the partitions present in ``rows`` are replaced.

    Rows are dealt by ranges of partition and order, so a large partition is
    sorted and written by many tasks, each a file of one run of the order.
    """
    rows.repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def incremental_days(last: DataFrame, now: str) -> DataFrame:
    """Days to request for each key: since the last bar plus five, seven at least; null when there is none."""
    return last.withColumn("days", F.greatest(F.datediff(F.lit(now).cast("date"), F.to_date("last_time")) + 5, F.lit(7)))


def close_and_note(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``exit_date`` and ``source`` come from the new row where there is one, ``notes`` only where it has some."""
    return upsert_merge(existing, new, keys, overwrite=["exit_date", "source"], fill=["notes"])


def export_months(rows: DataFrame, path: str, *, day: str | None = None, order: list[str] = ("symbol", "time")) -> None:
    """The month before that of ``day`` (default: all months), partitioned by year and month."""
    at = F.col("time")
    if day is not None:
        first = F.trunc(F.lit(day).cast("date"), "month")
        rows = rows.where((F.to_date(at) >= F.add_months(first, -1)) & (F.to_date(at) < first))
    export(rows.withColumn("year", F.year(at)).withColumn("month", F.month(at)), path, ["year", "month"], list(order))


def export_year(rows: DataFrame, path: str, year: int, order: list[str] = ("symbol", "time")) -> None:
    """One calendar year, replacing only its partition; the current, partial year alike."""
    at = F.col("time")
    export(rows.where(F.year(at) == year).withColumn("year", F.year(at)), path, ["year"], list(order))


def newest(names: DataFrame, name: str = "name", stamp: str | None = None) -> DataFrame:
    """The last backup by name, or that of a stamp."""
    return names.agg(F.max(name).alias(name)) if stamp is None else names.where(F.col(name).contains(stamp))


def expired(names: DataFrame, now: str, days: dict[str, int]) -> DataFrame:
    """Backups (``kind, name, day``) older than their kind's number of days."""
    keep = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in days.items()])
    return names.where(F.datediff(F.lit(now).cast("date"), "day") > keep)


def running_total(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each key and their running total in the order of keys. The window holds one row a key, not the rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("total_written", F.sum("n").over(Window.orderBy(key)))
