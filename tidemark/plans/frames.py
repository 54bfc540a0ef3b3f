"""Scans, filters, joins, aggregates, windows and set operations by the library; their SQL is in ``shared_sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import ingest, metrics, monitoring, quality, universe
from tidemark.plans.registry import query
from tidemark.sources.market import bars_daily, constituents, half_open, symbols, table, ticks

def _by_symbol() -> WindowSpec:
    return ind.series("symbol")


def _bucket(unit: str) -> Column:
    return F.date_trunc(unit, "time").cast("timestamp_ntz")


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of which those of one trade have no open and close and a volume of zero."""
    several = F.col("volume") > 1
    return bars_daily(spark, sf_dir).select("symbol", "time", F.when(several, F.col("open")).alias("open"), F.when(several, F.col("close")).alias("close"), (F.col("volume") - 1).alias("volume"))


@query("scan_bars_range")
def _scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).where(F.col("symbol").isin("1-URGENT", "2-HIGH") & half_open(F.col("time"), "1996-01-01", "1996-12-31"))


@query("scan_bars_joined")
def _scan_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = symbols(spark, sf_dir).where(F.col("market").isin("ASIA", "EUROPE"))
    return ticks(spark, sf_dir).join(wanted, "symbol_id").select("ticker", "time", "price")


@query("star_join_bars")
def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).join(symbols(spark, sf_dir), "symbol_id").groupBy("market", "exchange").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("filter_in")
def _filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).where(F.col("exchange").isin("NATION_3", "NATION_7", "NATION_12")).select("symbol_id", "ticker")


@query("filter_range")
def _filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("value").between(10, 50)).select("event_id", "ts")


@query("drop_null_open")
def _drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir).where("open is not null").select("symbol", "time", "open")


@query("asx200_current")
def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constituents(spark, sf_dir).where("index_code = 'BUILDING' and exit_date is null").select("symbol_id", "entry_date")


@query("index_universe_full")
def _index_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constituents(spark, sf_dir).join(symbols(spark, sf_dir), "symbol_id").select("index_code", "ticker", "exchange", "entry_date", "exit_date")


@query("ever_constituents")
def _ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = constituents(spark, sf_dir).where(F.col("index_code").isin("BUILDING", "MACHINERY"))
    return symbols(spark, sf_dir).join(members, "symbol_id", "left_semi").select("ticker", "exchange").distinct()


@query("short_history")
def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol_id").agg(F.count("*").alias("bars")).where("bars < 60")


@query("align_semi")
def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir).select("symbol", "time")
    return bars.where("symbol = '1-URGENT'").select("time").join(bars.where("symbol = '5-LOW'").select("time"), "time", "left_semi").distinct()


@query("universe_at_date")
def _at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.at_date(constituents(spark, sf_dir), "BUILDING", "1998-06-01")


@query("universe_overlap")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.overlapping(constituents(spark, sf_dir), "1998-01-01", "1998-12-31")


@query("universe_daily_counts")
def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.daily_counts(constituents(spark, sf_dir), table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))


@query("calendar_align")
def _calendar_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol on every day: the dense table is what is asked for."""
    bars = bars_daily(spark, sf_dir).select("symbol", "time", "close")
    grid = bars.select("time").distinct().crossJoin(bars.select("symbol").distinct())
    return grid.join(bars, ["symbol", "time"], "left").withColumn("has_bar", F.col("close").isNotNull())


@query("bench_align")
def _bench_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir)
    bench = bars.where("symbol = '5-LOW'").select("time", F.col("close").alias("b"))
    return bars.where("symbol <> '5-LOW'").select("symbol", "time", F.col("close").alias("s")).join(bench, "time").where("s is not null and b is not null")


@query("append_missing")
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = constituents(spark, sf_dir).where("index_code = 'BUILDING'").select("symbol_id")
    wanted = table(spark, sf_dir, "customer").where("c_custkey <= 20").select(F.col("c_custkey").alias("symbol_id"))
    return members.withColumn("kind", F.lit("member")).unionByName(wanted.join(members, "symbol_id", "left_anti").withColumn("kind", F.lit("benchmark")))


@query("symbols_per_day")
def _per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).groupBy("time").agg(F.count(F.when(F.col("volume") > 1, F.col("symbol"))).alias("n"))


@query("topk_recent")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.where("o_orderstatus = 'F'").join(c, o["o_custkey"] == c["c_custkey"]).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "c_name", "o_orderdate")


@query("time_bucket_day")
def _day_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy(_bucket("day").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("time_bucket_week")
def _week_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy(_bucket("week").alias("bucket")).agg(F.count("*").alias("n"))


@query("first_last_agg")
def _first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol_id").agg(F.min_by("price", F.struct("time", "event_id")).alias("first_price"), F.max_by("price", F.struct("time", "event_id")).alias("last_price"))


@query("last_bar")
def _last_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol_id").agg(F.max("time").alias("last_time"))


@query("table_counts")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts({name: table(spark, sf_dir, name) for name in ("orders", "events", "customer", "lineitem", "part")})


@query("ratio_nullif")
def _ratio_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 1).alias("ratio"))


@query("coverage_summary")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(bars_daily(spark, sf_dir), "symbol", thin=F.col("volume") == 1)


@query("change_counts")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.when(F.col("exit_date").isNull(), F.array(F.lit("ADD"))).otherwise(F.array(F.lit("ADD"), F.lit("REMOVE")))
    return constituents(spark, sf_dir).select(F.explode(actions).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query("coalesce_sum")
def _coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda status: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))), F.lit(0.0))
    return table(spark, sf_dir, "orders").agg(total("none").alias("nothing"), F.round(total("F"), 2).alias("total"))


@query("latest_per_key")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"))


@query("return_histogram")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars_daily(spark, sf_dir).select("symbol", ind.period_return(F.col("close"), _by_symbol()).alias("r")).where("r is not null")
    return r.groupBy("symbol", F.floor((F.col("r") + 1) / 0.25).alias("bin")).agg(F.count("*").alias("n"))


@query("return_histogram_80", """WITH r AS (SELECT * FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1 AS r FROM [daily]) x WHERE r IS NOT NULL), e AS (SELECT symbol, min(r) AS low, max(r) - min(r) AS width FROM r GROUP BY symbol)
SELECT e.symbol, CAST(k AS INTEGER) AS bin, round(low + width * k / 80, 9) AS low, (SELECT count(*) FROM r WHERE r.symbol = e.symbol AND least(floor((r.r - e.low) / e.width * 80), 79) = k) AS n FROM e, range(80) g(k)""")
def _histogram_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of each symbol in 80 bins between the least and the largest."""
    r = bars_daily(spark, sf_dir).select("symbol", ind.period_return(F.col("close"), _by_symbol()).alias("r"))
    return metrics.histogram(r, "symbol", "r", 80).withColumn("low", F.round("low", 9))


@query("argmax_per_key", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS price FROM orders GROUP BY o_custkey")
def _argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order of the latest date; of equal dates the largest key."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at).alias("latest"), F.max_by("o_totalprice", at).alias("price"))


@query("label_values")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("kind").distinct()


@query("win_rate")
def _win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close").where("r is not null")
    return r.groupBy("symbol").agg(metrics.win_rate(F.col("r")).alias("win_rate"), F.round(F.avg("r"), 9).alias("avg_trade"))


@query("dq_nonpositive")
def _nonpositive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("symbol"), F.col("c_custkey").alias("time"), F.col("c_acctbal").alias("close"))
    return quality.nonpositive(rows, "symbol", "close")


@query("dq_nulls")
def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tally(_opened(spark, sf_dir), "symbol", F.col("close").isNull())


@query("dq_zero_volume")
def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tally(_opened(spark, sf_dir), "symbol", F.col("volume") == 0)


@query("session_gaps")
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir).select("symbol", "time")
    return quality.gaps(bars, "symbol", universe.trading_days(bars.select(F.to_date("time").alias("day"))), 4)


@query("dedup_keep_last")
def _keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return ingest.keep_last(o, ["o_custkey", F.to_date("o_orderdate")], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


@query("next_open")
def _next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", F.lead("open").over(_by_symbol()).alias("next_open"))


@query("rebase")
def _rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bars_daily(spark, sf_dir).select("symbol", "time", (F.col("close") / F.first("close").over(whole) * 100_000).alias("value"))


@query("shift_trading_days")
def _shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = universe.trading_days(bars_daily(spark, sf_dir).select(F.to_date("time").alias("day")))
    asked = spark.range(1).select(F.lit("1998-06-01").cast("date").alias("asked"))
    return universe.shifted(asked, "asked", calendar, 54, "day").select(F.col("day").cast("timestamp_ntz").alias("shifted"))


@query("is_oos_split")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.when(F.col("time") < _day("1999-01-01"), "IS").otherwise("OOS")
    return bars_daily(spark, sf_dir).groupBy(sample.alias("sample"), "symbol").agg(F.count("*").alias("n"))


@query("needs_backfill")
def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("symbol_id").join(ticks(spark, sf_dir), "symbol_id", "left_anti")


@query("sync_new")
def _sync_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= _day("1999-01-01")).select(F.col("o_custkey").alias("symbol_id"))
    return universe.sync(live, constituents(spark, sf_dir).where("exit_date is null").select("symbol_id"), "symbol_id")[0]


@query("retention_filter")
def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).where(F.col("time") >= _day("1999-01-01")).select("symbol", "time", "close")


@query("partition_keys")
def _partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).groupBy("symbol", F.year("time").cast("long").alias("year"), F.month("time").cast("long").alias("month")).agg(F.count("*").alias("n"))


@query("market_rollup")
def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("market").isin("ASIA", "MIDDLE EAST"), "EAST").otherwise("WEST")
    return ticks(spark, sf_dir).join(symbols(spark, sf_dir), "symbol_id").groupBy(side.alias("market"), F.year("time").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("mem_by_name")
def _mem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy(F.col("kind").alias("name"), _bucket("hour").alias("step")).agg(F.round(F.sum("price"), 2).alias("total"))


@query("disk_ratio_alert")
def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol_id").agg((F.min("price") / F.nullif(F.max("price"), F.lit(0.0))).alias("ratio")).where("ratio < 0.0015")


@query("absent_3m")
def _absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return monitoring.absent(rows.select("symbol_id"), rows, ["symbol_id"], "2024-01-15 00:00:00", 3)
