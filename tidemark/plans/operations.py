"""Ingest, export, refresh, streaming, dashboards and backups."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import ingest, monitoring, rollup
from tidemark.plans.registry import query
from tidemark.sources.market import bars_daily, constituents, listings, symbols, table, ticks
from tidemark.sources.shared import csv_members, inventory, scan, shared_path
from tidemark.sources.stored import Stored
from tidemark.streaming import alerts
from tidemark.streaming import bars as streams

BAR = "symbol string, time timestamp_ntz, open double, high double, low double, close double, volume long"


@query("export_year", "SELECT symbol, time, close, CAST(year(time) AS INTEGER) AS year FROM [daily] WHERE year(time) IN (1997, 1998)")
def _export_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years are exported, the second one twice; a part of it first, as for a year that isn't over."""
    path, bars = shared_path(spark, "export"), bars_daily(spark, sf_dir)
    ingest.export_year(bars, path, 1997)
    ingest.export_year(bars.where("month(time) < 6"), path, 1998)
    ingest.export_year(bars, path, 1998)
    return spark.read.parquet(path).select("symbol", "time", "close", "year")


@query("export_month", "SELECT symbol_id, time, price, CAST(2023 AS INTEGER) AS year, CAST(12 AS INTEGER) AS month FROM [ticks] WHERE false UNION ALL SELECT symbol_id, time, price, 2024, 1 FROM [ticks] WHERE time < TIMESTAMP '2024-02-01 00:00:00'")
def _export_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month before February 2024."""
    path = shared_path(spark, "export")
    ingest.export_months(ticks(spark, sf_dir), path, day="2024-02-15", order=["symbol_id", "time"])
    return spark.read.parquet(path).select("symbol_id", "time", "price", "year", "month")


@query("file_inventory")
def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "inventory")
    ingest.export_year(bars_daily(spark, sf_dir), path, 1997)
    return inventory(spark, path)


@query("scan_missing", "SELECT symbol, time, close FROM [daily] WHERE false")
def _scan_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder without Parquet files gives no rows, with the schema."""
    path = shared_path(spark, "empty")
    spark.createDataFrame([("none",)], "value string").write.text(path)
    return scan(spark, path, BAR).select("symbol", "time", "close")


@query("csv_members", "SELECT upper(c_name) AS ticker, c_mktsegment AS sector FROM customer WHERE c_mktsegment = 'BUILDING'")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with a byte-order mark before its header, spaces around values and rows without a ticker."""
    path = shared_path(spark, "members")
    c = table(spark, sf_dir, "customer")
    lines = c.select(F.concat(F.lit(" "), F.lower("c_name"), F.lit(" ")).alias("\ufeffTicker"), F.lit("a name").alias("Name"), F.concat("c_mktsegment", F.lit(" ")).alias("Sector"))
    nameless = spark.range(1).select(F.lit("").alias("\ufeffTicker"), F.lit("no ticker").alias("Name"), F.lit("BUILDING").alias("Sector"))
    # Each file of the list has its own header.
    lines.unionByName(nameless).write.options(header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return csv_members(spark, path, sector="BUILDING").select("ticker", "sector")


@query("indicators_with_symbol", "SELECT s.ticker, s.exchange AS listed_on, x.time, round(x.sma, 6) AS sma_3 FROM (SELECT symbol_id, time, CASE WHEN count(price) OVER w = 3 THEN avg(price) OVER w END AS sma FROM [ticks] WINDOW w AS (PARTITION BY symbol_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) x JOIN [symbols] s ON s.symbol_id = x.symbol_id")
def _with_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ticks(spark, sf_dir).select("symbol_id", "time", ind.sma(F.col("price"), ind.series("symbol_id"), 3).alias("sma_3"))
    named = symbols(spark, sf_dir).select("symbol_id", "ticker", F.col("exchange").alias("listed_on"))
    return values.join(named, "symbol_id").select("ticker", "listed_on", "time", F.round("sma_3", 6).alias("sma_3"))


@query("upsert_constituent", "SELECT symbol_id, entry_date, CASE WHEN symbol_id % 2 = 0 THEN DATE '2002-01-01' ELSE exit_date END AS exit_date, CASE WHEN symbol_id % 2 = 0 THEN 'new' ELSE 'old' END AS source, CASE WHEN symbol_id % 4 = 0 THEN 'closed' ELSE 'kept' END AS notes FROM [members] m")
def _constituent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = constituents(spark, sf_dir).select("symbol_id", "entry_date", "exit_date")
    old = m.withColumn("source", F.lit("old")).withColumn("notes", F.lit("kept"))
    new = m.where("symbol_id % 2 = 0").select("symbol_id", "entry_date", F.lit("2002-01-01").cast("date").alias("exit_date"), F.lit("new").alias("source"), F.when(F.col("symbol_id") % 4 == 0, "closed").alias("notes"))
    return ingest.close_and_note(old, new, ["symbol_id", "entry_date"])


@query("upsert_ignore_intraday", "SELECT symbol_id, bucket, min_by(price, event_id) AS open FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, time) AS bucket FROM [ticks]) t GROUP BY symbol_id, bucket")
def _intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of ten minutes; those there already stay, and rows without an open are skipped."""
    bucket = F.window(F.col("time").cast("timestamp"), "10 minutes")["start"].cast("timestamp_ntz")
    bars = ticks(spark, sf_dir).groupBy("symbol_id", bucket.alias("bucket")).agg(F.min_by("price", "event_id").alias("open"))
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    empty = bars.select("symbol_id", (F.col("bucket") + F.expr("interval 1 year")).alias("bucket"), F.lit(None).cast("double").alias("open"))
    return ingest.upsert_ignore(bars.where(F.col("bucket") < half), bars.unionByName(empty), ["symbol_id", "bucket"])


@query("upsert_indicator", "SELECT symbol, time, CASE WHEN time < DATE '1998-01-01' THEN 'sma' ELSE 'sma again' END AS name, close AS value FROM [daily]")
def _indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is there already isn't replaced."""
    values = bars_daily(spark, sf_dir).select("symbol", "time", F.lit("sma").alias("name"), F.col("close").alias("value"))
    old = values.where(F.col("time") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return ingest.upsert_ignore(old, values.withColumn("name", F.lit("sma again")), ["symbol", "time"], needed="value")


@query("rows_written", "SELECT symbol, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY symbol) AS BIGINT) AS total_written FROM [daily] GROUP BY symbol")
def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total over symbols of what a load writes."""
    return ingest.running_total(bars_daily(spark, sf_dir), "symbol")


@query("ohlcv_refresh", "SELECT symbol_id, date_trunc('hour', time) AS bucket, sum(price) AS total, count(*) AS n FROM [ticks] WHERE time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-12 00:00:00' GROUP BY symbol_id, date_trunc('hour', time)")
def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup is empty until its first refresh; one of two days, then one of a part of them, builds these only."""
    build = lambda rows: rows.groupBy("symbol_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("bucket")).agg(F.sum("price").alias("total"), F.count("*").alias("n"))
    source = ticks(spark, sf_dir)
    first = rollup.refresh(build(source.where("false")), source, "2024-01-10 00:00:00", "2024-01-12 00:00:00", build)
    return rollup.refresh(first, source, "2024-01-11 00:00:00", "2024-01-12 00:00:00", build)


@query("ohlcv_from_bars", "SELECT symbol_id, date_trunc('day', time) AS bucket, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS bar_count FROM [ticks] GROUP BY symbol_id, date_trunc('day', time)")
def _from_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from hours, which come from ticks; counts add up."""
    hours = rollup.ohlcv(ticks(spark, sf_dir), "symbol_id", F.date_trunc("hour", "time").cast("timestamp_ntz"), tie="event_id")
    return rollup.coarser(hours, "symbol_id", F.date_trunc("day", "bucket").cast("timestamp_ntz"))


@query("stream_ohlcv_1h")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours that a stream over the ticks has closed when it has read all; ticks come in the order of the file."""
    source = shared_path(spark, "stream")
    ticks(spark, sf_dir).select("symbol_id", F.col("time").cast("timestamp").alias("time"), "price", "size").write.parquet(source)
    stream = spark.readStream.schema("symbol_id long, time timestamp, price double, size long").parquet(source)
    out, at = shared_path(spark, "bars"), shared_path(spark, "checkpoint")
    run = streams.stream_ohlcv(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("symbol_id long, bucket timestamp, open double, high double, low double, close double, volume long, bar_count long").parquet(out)


def _streamed(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A stream of what ``frame`` holds now."""
    source = shared_path(spark, "stream")
    frame.write.parquet(source)
    return spark.readStream.schema(frame.schema).parquet(source)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has put out when it has read all."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, "out")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, ticks(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp")))


@query("stream_vwap_1d", "SELECT symbol_id, date_trunc('day', time)::TIMESTAMP AS bucket, round(sum(price * size) / nullif(sum(size), 0), 6) AS vwap, CAST(sum(size) AS BIGINT) AS total_volume FROM [ticks] GROUP BY symbol_id, date_trunc('day', time) HAVING date_trunc('day', time) + INTERVAL 1 DAY <= (SELECT max(time) - INTERVAL 1 DAY FROM [ticks])")
def _stream_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the watermark, a day behind the last tick, has closed."""
    found = _drained(streams.stream_vwap(_stream_ticks(spark, sf_dir)))
    return found.select("symbol_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.round("vwap", 6).alias("vwap"), "total_volume")


@query("stream_distinct_kinds", "SELECT DISTINCT symbol_id, kind FROM [ticks]")
def _stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's kinds, once."""
    return _drained(streams.stream_distinct(_stream_ticks(spark, sf_dir), ["symbol_id", "kind"])).select("symbol_id", "kind")


@query("stream_alert_lifecycle")
def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of ``alert_lifecycle`` that a stream over the ticks has seen end."""
    alerts.use_state_store(spark)
    value = F.when(F.col("kind") == "signup", 0.0).otherwise(F.col("price"))
    samples = _streamed(spark, ticks(spark, sf_dir).select("symbol_id", F.col("time").cast("timestamp").alias("time"), value.alias("value")))
    return _drained(alerts.stream_alerts(samples, ["symbol_id"], 50, 120))


CLOCKS = ["2024-01-12 00:00:00", "2024-01-20 00:00:00", "2024-01-31 00:00:00"]
POLICY_SQL = f"""WITH w AS (SELECT k, CAST(c AS TIMESTAMP) - INTERVAL 10 DAY AS since, CAST(c AS TIMESTAMP) - INTERVAL 1 DAY AS until FROM (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(CLOCKS))}) v(k, c)),
t AS (SELECT *, date_trunc('hour', time) AS bucket, event_id % 3 AS load FROM [ticks]), b AS (SELECT bucket, max(k) AS k FROM (SELECT DISTINCT bucket FROM t) d JOIN w ON bucket >= since AND bucket < until GROUP BY bucket)
SELECT symbol_id, t.bucket, arg_min(price, struct_pack(a := time, e := event_id)) AS open, arg_max(price, struct_pack(a := time, e := event_id)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS bar_count FROM t JOIN b ON t.bucket = b.bucket WHERE load <= k GROUP BY symbol_id, t.bucket"""


@query("rollup_policy", POLICY_SQL)
def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks come in three loads, each with rows of all days; after each the policy builds the hours from ten days to one day before its clock."""
    tick = "symbol_id long, time timestamp_ntz, price double, size long, event_id long"
    source, notes = (Stored(spark, shared_path(spark, n), f"{s}, bucket timestamp_ntz, part string", "part") for n, s in (("ticks", tick), ("notes", "symbol_id long, open boolean")))
    target = Stored(spark, shared_path(spark, "hours"), "symbol_id long, bucket timestamp_ntz, open double, high double, low double, close double, volume long, bar_count long, day date", "day")
    build = lambda rows: rollup.ohlcv(rows, "symbol_id", F.col("bucket"), tie="event_id")
    policy = rollup.Policy(source, notes, target, "symbol_id", build, width=3600, start=10 * 86_400, end=86_400)
    folder, kept, rows = shared_path(spark, "loads"), shared_path(spark, "checkpoint"), ticks(spark, sf_dir)
    for load in range(len(CLOCKS)):
        rows.where(F.col("event_id") % 3 == load).select("symbol_id", "time", "price", "size", "event_id").write.mode("append").parquet(folder)
        stream = streams.follow(spark.readStream.schema(tick).parquet(folder), policy, lambda number: datetime.datetime.fromisoformat(CLOCKS[number]))
        stream.option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    return target.read().select("symbol_id", "bucket", "open", "close", "volume", "bar_count")


@query("first_writer_wins", "SELECT symbol_id, bucket, min_by(price, struct_pack(l := event_id % 3, e := event_id)) AS open FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, time) AS bucket FROM [ticks] WHERE kind <> 'signup') t GROUP BY symbol_id, bucket")
def _first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads into a stored table of ten-minute bars, partitioned by day; signups have no open."""
    store = Stored(spark, shared_path(spark, "bars"), "symbol_id long, bucket timestamp_ntz, open double, day date", "day")
    bucket = F.window(F.col("time").cast("timestamp"), "10 minutes")["start"].cast("timestamp_ntz")
    rows = ticks(spark, sf_dir).select("symbol_id", bucket.alias("bucket"), F.when(F.col("kind") != "signup", F.col("price")).alias("open"), F.to_date("time").alias("day"), "event_id")
    for load in range(3):
        ingest.insert_first(store, rows.where(F.col("event_id") % 3 == load), ["symbol_id", "bucket"], arrival="event_id")
    return store.read().select("symbol_id", "bucket", "open")


@query("latest_backup", "SELECT max(c_name) AS name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_name LIKE '%000000017%'")
def _latest_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last name, and that of a stamp."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return ingest.newest(names).unionByName(ingest.newest(names, stamp="000000017"))


@query("backup_retention", "SELECT o_orderstatus AS kind, o_orderkey AS name FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '2001-08-01' - CAST(CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 30 END AS INTEGER)")
def _backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those older than 7 and 30 days; a kind without a rule stays."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("name"), F.to_date("o_orderdate").alias("day"))
    return ingest.expired(rows, "2001-08-01", {"F": 7, "O": 30}).select("kind", "name")


@query("disk_levels", "SELECT symbol_id, CASE WHEN p >= 90 THEN 'critical' WHEN p >= 80 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT symbol_id, avg(price) / max(price) * 300 AS p FROM [ticks] GROUP BY symbol_id) x")
def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ticks(spark, sf_dir).groupBy("symbol_id").agg((F.avg("price") / F.max("price") * 300).alias("p"))
    return share.select("symbol_id", monitoring.level(F.col("p")).alias("level"))


@query("alert_states", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'ok' WHEN c_acctbal > 5000 THEN 'alerting' ELSE 'ok' END AS state FROM customer")
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No data is ok."""
    key = F.col("c_custkey")
    values = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("value"))
    return monitoring.alert_state(values, "value", 5000.0).select("id", "state")


@query("container_table", "SELECT c_name AS Container, c_acctbal AS Memory FROM customer WHERE regexp_full_match(c_name, 'Customer#0+1[0-9]?')")
def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dashboard's table with its template variable."""
    return monitoring.panel(table(spark, sf_dir, "customer"), {"c_name": "Container", "c_acctbal": "Memory"}, "c_name", "Customer#0+1[0-9]?")


@query("absent_all", "SELECT symbol_id FROM [ticks] WHERE false GROUP BY symbol_id")
def _absent_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As one alert over all names: nothing while any of them has a sample."""
    rows = ticks(spark, sf_dir)
    return monitoring.absent(rows.select("symbol_id"), rows, ["symbol_id"], "2024-01-15 00:00:00", 600, whole=True)


@query("absent_all_fires", "SELECT DISTINCT symbol_id FROM [ticks]")
def _absent_all_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long after the last sample no name has any, so the alert fires for all."""
    rows = ticks(spark, sf_dir)
    return monitoring.absent(rows.select("symbol_id"), rows, ["symbol_id"], "2025-01-01 00:00:00", 60, whole=True)


@query("head_symbols", "SELECT symbol_id, count(*) AS n FROM [ticks] GROUP BY symbol_id ORDER BY symbol_id LIMIT 20")
def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 symbols by id: the limit is what is asked for."""
    return ticks(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("n")).orderBy("symbol_id").limit(20)


@query("sorted_export", "SELECT symbol, time, close FROM [daily]")
def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", "close").orderBy("symbol", "time")


@query("listed_symbols", "SELECT symbol_id, CAST(min(time) AS DATE) + CAST(symbol_id % 7 AS INTEGER) AS entry_date FROM [ticks] GROUP BY symbol_id")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("symbol_id", "entry_date")
