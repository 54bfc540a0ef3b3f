"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import indicators as ind
from tidemark.functions import recursive
from tidemark.operators import backtest, digest, ingest, metrics, monitoring, rollup, text, universe
from tidemark.plans.registry import FOUND, SQL, query
from tidemark.plans.shared_sql import RAW, for_check
from tidemark.sources.market import announcements, bars_daily, constituents, table, ticker_of, ticks

for _name, _sql in RAW.items():
    SQL[_name] = for_check(_sql)


def by_time() -> WindowSpec:
    return ind.series("symbol")


def close() -> Column:
    return F.col("close")


def _ohlcv_sql(unit: str) -> str:
    return f"SELECT symbol_id, date_trunc('{unit}', time) AS bucket, arg_min(price, struct_pack(t := time, e := event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(t := time, e := event_id)) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS bar_count FROM [ticks] GROUP BY symbol_id, date_trunc('{unit}', time)"


@query("ohlcv_1h", _ohlcv_sql("hour"))
def _ohlcv_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ohlcv(ticks(spark, sf_dir), "symbol_id", F.date_trunc("hour", "time").cast("timestamp_ntz"), tie="event_id")


@query("ohlcv_1d", _ohlcv_sql("day"))
def _ohlcv_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ohlcv(ticks(spark, sf_dir), "symbol_id", F.date_trunc("day", "time").cast("timestamp_ntz"), tie="event_id")


@query("daily_vwap", "SELECT symbol_id, date_trunc('day', time) AS bucket, round(sum(price * size) / nullif(sum(size), 0), 6) AS vwap, CAST(sum(size) AS BIGINT) AS total_volume FROM [ticks] GROUP BY symbol_id, date_trunc('day', time)")
def _vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.vwap(ticks(spark, sf_dir), "symbol_id", F.date_trunc("day", "time").cast("timestamp_ntz"))
    return found.withColumn("vwap", F.round("vwap", 6))


@query("sma_20", "SELECT symbol, time, round(avg(close) OVER w, 4) AS sma_20, round(stddev_samp(close) OVER w, 4) AS stddev_20 FROM [daily] WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _sma_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", F.round(ind.sma_partial(close(), by_time(), 20), 4).alias("sma_20"), F.round(ind.stddev_partial(close(), by_time(), 20), 4).alias("stddev_20"))


@query("bollinger", "SELECT symbol, time, round(m + 2 * s, 4) AS bb_upper, round(m - 2 * s, 4) AS bb_lower FROM (SELECT symbol, time, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM [daily] WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) x")
def _bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = ind.sma_partial(close(), by_time(), 20), ind.stddev_partial(close(), by_time(), 20)
    return bars_daily(spark, sf_dir).select("symbol", "time", F.round(m + 2 * s, 4).alias("bb_upper"), F.round(m - 2 * s, 4).alias("bb_lower"))


@query("volatility_20d", "SELECT symbol, time, round(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252), 6) AS volatility FROM (SELECT symbol, time, CASE WHEN close > 0 AND p > 0 THEN ln(close / p) END AS r FROM (SELECT symbol, time, close, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS p FROM [daily]) x) y")
def _volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars_daily(spark, sf_dir).select("symbol", "time", ind.log_return(close(), by_time()).alias("r"))
    return r.select("symbol", "time", F.round(ind.stddev_partial(F.col("r"), by_time(), 20) * ind.ANNUAL, 6).alias("volatility"))


@query("sma_strict", "SELECT symbol, time, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w, 4) END AS sma_20 FROM [daily] WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _sma_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", F.round(ind.sma(close(), by_time(), 20), 4).alias("sma_20"))


@query("atr_14", "SELECT symbol, time, CASE WHEN count(tr) OVER w = 14 THEN round(avg(tr) OVER w, 4) END AS atr_14 FROM (SELECT symbol, time, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS p FROM [daily]) a) b WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")
def _atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = bars_daily(spark, sf_dir).select("symbol", "time", ind.true_range(F.col("high"), F.col("low"), close(), by_time()).alias("tr"))
    return tr.select("symbol", "time", F.round(ind.sma(F.col("tr"), by_time(), 14), 4).alias("atr_14"))


AVERAGES = "(SELECT symbol, time, CASE WHEN count(close) OVER f = 20 THEN avg(close) OVER f END AS fast, CASE WHEN count(close) OVER s = 50 THEN avg(close) OVER s END AS slow FROM [daily] WINDOW f AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY time ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


def _averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", ind.sma(close(), by_time(), 20).alias("fast"), ind.sma(close(), by_time(), 50).alias("slow"))


@query("sma_crossover", f"SELECT symbol, time, coalesce(fast > slow AND pf <= ps, false) AS entry, coalesce(fast < slow AND pf >= ps, false) AS exit FROM (SELECT *, lag(fast) OVER (PARTITION BY symbol ORDER BY time) AS pf, lag(slow) OVER (PARTITION BY symbol ORDER BY time) AS ps FROM {AVERAGES} a) b")
def _crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry, leave = ind.crossings(F.col("fast"), F.col("slow"), by_time())
    return _averages(spark, sf_dir).select("symbol", "time", entry.alias("entry"), leave.alias("exit"))


@query("sma_crossover_compat", f"SELECT symbol, time, above AND NOT was AND fast IS NOT NULL AND slow IS NOT NULL AS entry, NOT above AND was AND fast IS NOT NULL AND slow IS NOT NULL AS exit FROM (SELECT *, coalesce(lag(above) OVER (PARTITION BY symbol ORDER BY time), false) AS was FROM (SELECT *, coalesce(fast > slow, false) AS above FROM {AVERAGES} a) b) c")
def _crossover_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry, leave = ind.crossings(F.col("fast"), F.col("slow"), by_time(), mode="compat")
    return _averages(spark, sf_dir).select("symbol", "time", entry.alias("entry"), leave.alias("exit"))


@query("sma_position", f"SELECT symbol, time, CASE WHEN fast IS NULL OR slow IS NULL THEN NULL WHEN fast > slow THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM {AVERAGES} a")
def _position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averages(spark, sf_dir).select("symbol", "time", ind.position(F.col("fast"), F.col("slow")).alias("position"))


@query("drawdown", "SELECT symbol, time, round((close - peak) / peak, 9) AS drawdown FROM (SELECT symbol, time, close, max(close) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM [daily]) x")
def _drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "time", F.round(ind.drawdown(close(), by_time()), 9).alias("drawdown"))


RETURNS = "(SELECT symbol, time, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1 AS r FROM [daily])"


@query("returns", f"SELECT symbol, time, round(r, 9) AS r FROM {RETURNS} x WHERE r IS NOT NULL")
def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars_daily(spark, sf_dir).select("symbol", "time", F.round(ind.period_return(close(), by_time()), 9).alias("r"))
    return r.where("r is not null")


@query("cum_return", f"SELECT symbol, time, round(exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM {RETURNS} x WHERE r IS NOT NULL")
def _cum_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bars_daily(spark, sf_dir).select("symbol", "time", ind.period_return(close(), by_time()).alias("r")).where("r is not null")
    return r.select("symbol", "time", F.round(F.product(1 + F.col("r")).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("growth"))


@query("clip_to_membership", "SELECT user_id AS symbol_id, ts AS time, value FROM (SELECT e.*, CAST(ts AS DATE) AS day FROM {events} e) e WHERE EXISTS (SELECT 1 FROM [members] m WHERE m.symbol_id = e.user_id AND m.entry_date <= e.day AND (m.exit_date IS NULL OR m.exit_date > e.day))")
def _clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol_id"), F.col("ts").alias("time"), "value")
    return universe.clip(rows, constituents(spark, sf_dir), "symbol_id")


@query("universe_daily_counts_all", "SELECT d.day, m.index_code, count(*) AS members FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}) d JOIN [members] m ON m.entry_date <= d.day AND (m.exit_date IS NULL OR m.exit_date > d.day) GROUP BY d.day, m.index_code")
def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return universe.daily_counts(constituents(spark, sf_dir), days)


@query("sync_exits", "SELECT symbol_id FROM (SELECT symbol_id, count(*) OVER () AS n FROM [members] m WHERE index_code = 'BUILDING' AND exit_date IS NULL AND symbol_id % 97 = 0) x WHERE n <= 20")
def _sync_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = constituents(spark, sf_dir).where("index_code = 'BUILDING' AND exit_date IS NULL").select("symbol_id")
    return universe.sync(now.where("symbol_id % 97 <> 0"), now, "symbol_id")[1]


@query("changes_to_intervals", "SELECT CAST(symbol_id AS VARCHAR) AS ticker, entry_date, exit_date FROM [members] m")
def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = constituents(spark, sf_dir).withColumn("ticker", F.col("symbol_id").cast("string"))
    adds = m.select("ticker", F.lit("ADD").alias("action"), F.col("entry_date").alias("effective_date"))
    removes = m.where("exit_date is not null").select("ticker", F.lit("REMOVE").alias("action"), F.col("exit_date").alias("effective_date"))
    return universe.intervals(adds.unionByName(removes))


@query("upsert_ignore", "SELECT symbol, time, open FROM [daily]")
def _upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir).select("symbol", "time", "open")
    return ingest.upsert_ignore(bars.where("time < timestamp_ntz'1998-01-01 00:00:00'"), bars.where("time >= timestamp_ntz'1997-06-01 00:00:00'"), ["symbol", "time"])


@query("upsert_symbol_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 WHEN c_custkey % 3 = 0 THEN c_custkey END AS con_id, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN true ELSE false END AS active FROM customer")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    old = c.select(key, F.when(key % 3 == 0, key).alias("con_id"), F.lit(False).alias("active"))
    new = c.where((key % 2 == 0) | (key % 5 == 0)).select(key, F.when(key % 2 == 0, key * 10).alias("con_id"), F.lit(True).alias("active"))
    return ingest.upsert_merge(old, new, ["c_custkey"], overwrite=["active"], fill=["con_id"]).select("c_custkey", "con_id", "active")


@query("close_interval", "SELECT symbol_id, entry_date, CASE WHEN exit_date IS NULL AND symbol_id % 2 = 0 THEN DATE '2002-01-01' ELSE exit_date END AS exit_date FROM [members] m")
def _close(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = constituents(spark, sf_dir).select("symbol_id", "entry_date", "exit_date")
    closures = m.where("symbol_id % 2 = 0").select("symbol_id", F.lit("2002-01-01").cast("date").alias("exit_date"))
    return ingest.close_open(m, closures, ["symbol_id"])


@query("incremental_window", "SELECT symbol_id, last_time, CAST(greatest(date_diff('day', CAST(last_time AS DATE), DATE '2030-01-01') + 5, 7) AS INTEGER) AS days FROM (SELECT symbol_id, max(time) AS last_time FROM [ticks] t GROUP BY symbol_id) x")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.incremental_days(ticks(spark, sf_dir).groupBy("symbol_id").agg(F.max("time").alias("last_time")), "2030-01-01")


CURVE = "(SELECT symbol, time, close AS v, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1 AS r, (close - max(close) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)) / max(close) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS d FROM [daily])"
SUMMARY_SQL = f"SELECT symbol, start_date, end_date, round(total, 4) AS total_return, round(growth, 4) AS cagr, round(deepest, 4) AS max_drawdown, round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(growth / nullif(deepest, 0), 4) AS calmar, 0.043::DOUBLE AS risk_free_rate, n FROM (SELECT symbol, CAST(min(time) AS DATE) AS start_date, CAST(max(time) AS DATE) AS end_date, max_by(v, time) / min_by(v, time) - 1 AS total, pow(max_by(v, time) / min_by(v, time), 365.25 / date_diff('day', CAST(min(time) AS DATE), CAST(max(time) AS DATE))) - 1 AS growth, -min(d) AS deepest, (avg(r) - 0.043 / 252) / stddev_samp(r) * sqrt(252) AS sharpe, (avg(r) - 0.043 / 252) / stddev_samp(CASE WHEN r < 0.043 / 252 THEN r END) * sqrt(252) AS sortino, count(*) AS n FROM {CURVE} c GROUP BY symbol) x"


@query("summary", SUMMARY_SQL)
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(bars_daily(spark, sf_dir).withColumnRenamed("close", "value"), "symbol")


@query("sharpe", f"SELECT symbol, round((avg(r) - 0.043 / 252) / nullif(stddev_samp(r), 0) * sqrt(252), 6) AS sharpe, round(stddev_samp(r), 6) AS deviation FROM {RETURNS} x WHERE r IS NOT NULL GROUP BY symbol")
def _sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close")
    return r.groupBy("symbol").agg(F.round(metrics.sharpe(F.col("r"), 0.043), 6).alias("sharpe"), F.round(F.stddev_samp("r"), 6).alias("deviation"))


@query("sortino", f"SELECT symbol, round((avg(r) - 0.043 / 252) / stddev_samp(CASE WHEN r - 0.043 / 252 < 0 THEN r - 0.043 / 252 END) * sqrt(252), 6) AS sortino FROM {RETURNS} x WHERE r IS NOT NULL GROUP BY symbol")
def _sortino(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close").where("r is not null")
    return r.groupBy("symbol").agg(F.round(metrics.sortino(F.col("r"), 0.043), 6).alias("sortino"))


@query("profit_factor", f"SELECT symbol, round(sum(CASE WHEN r > 0 THEN r END) / abs(sum(CASE WHEN r < 0 THEN r END)), 6) AS profit_factor FROM {RETURNS} x GROUP BY symbol")
def _profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close")
    return r.groupBy("symbol").agg(F.round(metrics.profit_factor(F.col("r")), 6).alias("profit_factor"))


@query("cagr", "SELECT symbol, round(pow(max_by(close, time) / min_by(close, time), 365.25 / date_diff('day', CAST(min(time) AS DATE), CAST(max(time) AS DATE))) - 1, 9) AS cagr FROM [daily] GROUP BY symbol")
def _cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).groupBy("symbol").agg(F.round(metrics.cagr(close(), F.col("time")), 9).alias("cagr"))


@query("max_drawdown", "SELECT symbol, round(max((peak - close) / peak), 9) AS max_drawdown FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS peak FROM [daily]) x GROUP BY symbol")
def _max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close")
    return r.groupBy("symbol").agg(F.round(F.abs(F.min("drawdown")), 9).alias("max_drawdown"))


@query("benchmark_compare", f"SELECT a.symbol, round(regr_slope(a.r, b.r), 4) AS beta, round((avg(a.r) - regr_slope(a.r, b.r) * avg(b.r)) * 252, 4) AS alpha, round(stddev_samp(a.r - b.r) * sqrt(252), 4) AS tracking_error, round(avg(a.r - b.r) / stddev_samp(a.r - b.r) * sqrt(252), 4) AS information_ratio, count(*) AS n FROM {RETURNS} a JOIN {RETURNS} b ON a.time = b.time AND b.symbol = '5-LOW' WHERE a.symbol <> '5-LOW' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.symbol")
def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close")
    return metrics.against_benchmark(r.where("symbol <> '5-LOW'"), r.where("symbol = '5-LOW'"), "symbol")


FULL_SQL = f"""SELECT symbol, round(beta, 4) AS beta, round(alpha, 4) AS alpha, round(tracking_error, 4) AS tracking_error, round(information_ratio, 4) AS information_ratio, n, round(pow(own / own_first, 365.25 / days) - pow(other / other_first, 365.25 / days), 4) AS excess_return, round(own_sharpe, 4) AS strategy_sharpe, round(other_sharpe, 4) AS benchmark_sharpe
FROM (SELECT a.symbol, regr_slope(a.r, b.r) AS beta, (avg(a.r) - 0.043 / 252 - regr_slope(a.r, b.r) * (avg(b.r) - 0.043 / 252)) * 252 AS alpha, stddev_samp(a.r - b.r) * sqrt(252) AS tracking_error, avg(a.r - b.r) / stddev_samp(a.r - b.r) * sqrt(252) AS information_ratio, count(*) AS n,
  exp(sum(ln(1 + a.r))) AS own, 1 + arg_min(a.r, a.time) AS own_first, exp(sum(ln(1 + b.r))) AS other, 1 + arg_min(b.r, a.time) AS other_first, date_diff('day', CAST(min(a.time) AS DATE), CAST(max(a.time) AS DATE)) AS days,
  (avg(a.r) - 0.043 / 252) / stddev_samp(a.r) * sqrt(252) AS own_sharpe, (avg(b.r) - 0.043 / 252) / stddev_samp(b.r) * sqrt(252) AS other_sharpe
  FROM {RETURNS} a JOIN {RETURNS} b ON a.time = b.time AND b.symbol = '5-LOW' WHERE a.symbol <> '5-LOW' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.symbol) x"""


@query("benchmark_excess", FULL_SQL)
def _benchmark_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison with the yearly excess return and both Sharpe ratios, over a risk-free rate."""
    r = metrics.with_returns(bars_daily(spark, sf_dir), "symbol", "close")
    return metrics.against_benchmark(r.where("symbol <> '5-LOW'"), r.where("symbol = '5-LOW'"), "symbol", rf=0.043, full=True)


EMA_SQL = "WITH RECURSIVE b AS (SELECT symbol, time, close, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM [daily]), e AS (SELECT symbol, time, k, close AS v FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.time, b.k, {a} * b.close + (1 - {a}) * e.v FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1) SELECT symbol, time, round(v, 4) AS ema_12 FROM e"


@query("ema_12")
def _ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.ema(bars_daily(spark, sf_dir).select("symbol", "time", "close"), "symbol").select("symbol", "time", F.round("ema_12", 4).alias("ema_12"))


SQL["ema_12"] = for_check(EMA_SQL.replace("{a}", "(2.0::DOUBLE / 13)"))


MACD_SQL = """WITH RECURSIVE b AS (SELECT symbol, time, close, close - lag(close) OVER (PARTITION BY symbol ORDER BY time) AS d, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM [daily]),
e AS (SELECT symbol, time, k, close AS f, close AS s, CAST(0 AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down FROM b WHERE k = 1
  UNION ALL SELECT b.symbol, b.time, b.k, 2.0::DOUBLE / 13 * close + 11.0::DOUBLE / 13 * f, 2.0::DOUBLE / 27 * close + 25.0::DOUBLE / 27 * s,
    0.2::DOUBLE * (2.0::DOUBLE / 13 * close + 11.0::DOUBLE / 13 * f - 2.0::DOUBLE / 27 * close - 25.0::DOUBLE / 27 * s) + 0.8::DOUBLE * g,
    CASE WHEN up IS NULL THEN greatest(d, 0) ELSE greatest(d, 0) / 14 + up * 13 / 14 END, CASE WHEN down IS NULL THEN greatest(-d, 0) ELSE greatest(-d, 0) / 14 + down * 13 / 14 END
  FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1)
SELECT symbol, time, round(f - s, 3) AS macd, round(g, 3) AS macd_signal, CASE WHEN k > 14 THEN round(100 * up / (up + down), 3) END AS rsi FROM e"""


@query("macd_rsi", MACD_SQL)
def _macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.macd_rsi(bars_daily(spark, sf_dir), "symbol").select("symbol", "time", *[F.round(c, 3).alias(c) for c in ("macd", "macd_signal", "rsi")])


FASTS, SLOWS = [10, 20, 30], [50, 100]


def _average(n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN avg(close) {w} END AS a{n}"


def _signals_sql(keep: str) -> str:
    wide = f"(SELECT symbol, time, open, close, {', '.join(map(_average, [*FASTS, *SLOWS]))} FROM [daily])"
    lags = ", ".join(f"lag(a{n}) OVER (PARTITION BY symbol ORDER BY time) AS p{n}" for n in [*FASTS, *SLOWS])
    each = " UNION ALL ".join(f"SELECT symbol, time, open, close, {f} AS n_fast, {s} AS n_slow, coalesce(a{f} > a{s} AND p{f} <= p{s}, false) AS entry, coalesce(a{f} < a{s} AND p{f} >= p{s}, false) AS exit FROM w" for f in FASTS for s in SLOWS)
    return f"(WITH w AS (SELECT *, {lags} FROM {wide} a) SELECT * FROM ({each}) s WHERE {keep})"


@query("signal_grid", f"SELECT * FROM {_signals_sql('entry OR exit')} x")
def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.signal_grid(bars_daily(spark, sf_dir), "symbol", FASTS, SLOWS).where("entry or exit")


SINGLE_SQL = f"""SELECT symbol, n_fast, n_slow, time, held, round(ln(product(change) OVER (w ROWS UNBOUNDED PRECEDING)), 6) AS log_equity FROM (
  SELECT *, CASE WHEN held = 1 AND was = 0 THEN 0.999 * close / fill WHEN held = 0 AND was = 1 THEN 0.999 * fill / before WHEN held = 1 THEN close / before ELSE 1 END AS change FROM (
    SELECT *, coalesce(lag(held) OVER w, 0) AS was, lag(close) OVER w AS before FROM (
      SELECT *, coalesce(last_value(target IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS held FROM (
        SELECT *, CASE WHEN fill IS NULL THEN NULL WHEN entry THEN 1 WHEN exit THEN 0 END AS target FROM (
          SELECT *, lead(open) OVER w AS fill FROM {_signals_sql('true')} a WINDOW w AS (PARTITION BY symbol, n_fast, n_slow ORDER BY time)) b) c
      WINDOW w AS (PARTITION BY symbol, n_fast, n_slow ORDER BY time)) d WINDOW w AS (PARTITION BY symbol, n_fast, n_slow ORDER BY time)) e) f
  WINDOW w AS (PARTITION BY symbol, n_fast, n_slow ORDER BY time)"""


@query("single_stock_grid", SINGLE_SQL)
def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = backtest.signal_grid(bars_daily(spark, sf_dir), "symbol", FASTS, SLOWS)
    return backtest.single_stock(signals, ["symbol", "n_fast", "n_slow"]).withColumn("log_equity", F.round(F.log("equity"), 6)).drop("equity")


@query("html_link_extract", "SELECT DISTINCT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/]*') || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) x WHERE regexp_matches(href, '(?i)tion$')")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages link to no files; targets of one ending stand for those."""
    return text.links(table(spark, sf_dir, "pages"), "tion")


@query("regex_filter", "SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '.*0+[1-9][1-9]?')")
def _regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_name").rlike("^(?:.*0+[1-9][1-9]?)$")).select("c_custkey", "c_name")


ANNOUNCED = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS effective_date FROM orders"


@query("extract_date", ANNOUNCED)
def _date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).select("doc_id", text.date_in(F.col("text")).alias("effective_date"))


TICKER = "translate(lpad(CAST({} % 100000 AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ')"


@query("section_carry_forward", f"SELECT o_orderkey AS doc_id, CAST(2 AS INTEGER) AS no, {TICKER.format('o_orderkey')} AS ticker, 'ADD' AS action FROM orders UNION ALL SELECT o_orderkey, 3, {TICKER.format('o_orderkey + 7')}, 'ADD' FROM orders UNION ALL SELECT o_orderkey, 5, {TICKER.format('o_custkey')}, 'REMOVE' FROM orders")
def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.section_changes(announcements(spark, sf_dir), "doc_id", "text")


@query("table_changes", f"SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS no, {TICKER.format('o_orderkey')} AS ticker, 'ADD' AS action FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 1, {TICKER.format('o_orderkey')}, 'REMOVE' FROM orders WHERE o_orderkey % 4 = 1")
def _table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under an addition, a removal and another heading, and a broken one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    kind = F.col("doc_id") % 4
    head = F.array(F.lit("Code"), F.when(kind == 0, "Additions").when(kind == 1, "Removals").otherwise("Names"))
    row = F.array(F.lit("1."), F.concat(F.lit(" "), ticker_of(F.col("doc_id"))), F.lit("LATER"))
    cells = F.when(kind < 3, F.array(head, row, F.array(F.lit("Total of the day"))))
    return text.table_changes(o.withColumn("cells", cells), "doc_id", "cells")


@query("json_label", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("content_hash", "SELECT c_nationkey, md5(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT c_nationkey, md5(c_name) AS h FROM customer) x GROUP BY c_nationkey")
def _content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.content_digest(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_name"))


@query("content_changes", """WITH now AS (SELECT c_nationkey, md5(string_agg(md5(c_name), '' ORDER BY md5(c_name))) AS h FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey),
old AS (SELECT c_nationkey, md5(string_agg(md5(c_name), '' ORDER BY md5(c_name))) AS h FROM customer WHERE c_nationkey <> 4 AND (c_nationkey > 9 OR c_custkey % 2 = 0) GROUP BY c_nationkey)
SELECT coalesce(now.c_nationkey, old.c_nationkey) AS c_nationkey, CASE WHEN old.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'gone' ELSE 'changed' END AS change FROM now FULL JOIN old ON now.c_nationkey = old.c_nationkey WHERE now.h IS DISTINCT FROM old.h""")
def _content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests against those stored earlier: one nation was added since, one is gone, some had fewer customers."""
    c = table(spark, sf_dir, "customer")
    stored = digest.content_digest(c.where("c_nationkey <> 4 and (c_nationkey > 9 or c_custkey % 2 = 0)"), "c_nationkey", F.col("c_name"))
    return digest.changed(digest.content_digest(c.where("c_nationkey <> 3"), "c_nationkey", F.col("c_name")), stored, "c_nationkey")


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("symbol_id", "time", "event_id", F.when(F.col("kind") == "signup", 0.0).otherwise(F.col("price")).alias("value"))


@query("counter_rate", "SELECT symbol_id, time, round(sum(step) OVER (PARTITION BY symbol_id ORDER BY time RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) / 86400.0, 9) AS rate FROM (SELECT symbol_id, time, CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END AS step FROM (SELECT symbol_id, time, v, lag(v) OVER (PARTITION BY symbol_id ORDER BY time, event_id) AS p FROM (SELECT symbol_id, time, event_id, CASE WHEN kind = 'signup' THEN 0.0 ELSE price END AS v FROM [ticks]) a) b) c")
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.counter_rate(_counter(spark, sf_dir), ["symbol_id"], 86_400, tie="event_id", digits=2).select("symbol_id", "time", F.round("rate", 9).alias("rate"))


@query("uptime_days", "SELECT symbol_id, date_diff('day', CAST(first AS DATE), DATE '2030-01-01') AS days FROM (SELECT symbol_id, min(time) AS first FROM [ticks] GROUP BY symbol_id) x")
def _uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ticks(spark, sf_dir).groupBy("symbol_id").agg(F.min("time").alias("first"))
    return first.select("symbol_id", F.datediff(F.lit("2030-01-01").cast("date"), F.to_date("first")).cast("long").alias("days"))


@query("disk_ratio_matches", "SELECT symbol_id, kind, min(price) AS free, max(price) AS size, min(price) / nullif(max(price), 0) AS ratio FROM [ticks] GROUP BY symbol_id, kind HAVING min(price) / nullif(max(price), 0) < 0.15")
def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series matched on their full label set, divided, and filtered: one grouping gives both."""
    both = ticks(spark, sf_dir).groupBy("symbol_id", "kind").agg(F.min("price").alias("free"), F.max("price").alias("size"))
    return both.withColumn("ratio", F.col("free") / F.nullif("size", F.lit(0.0))).where("ratio < 0.15")


COUNTER = "(SELECT symbol_id, time, event_id, CASE WHEN kind = 'signup' THEN 0.0 ELSE price END AS v FROM [ticks])"
RATE = f"(SELECT symbol_id, time, sum(step) OVER (PARTITION BY symbol_id ORDER BY time RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) / 86400.0 AS rate FROM (SELECT symbol_id, time, CASE WHEN p IS NULL THEN 0.0 WHEN v < p THEN v ELSE v - p END AS step FROM (SELECT symbol_id, time, v, lag(v) OVER (PARTITION BY symbol_id ORDER BY time, event_id) AS p FROM {COUNTER} a) b) c)"


@query("cpu_pct_by_name", f"SELECT symbol_id, date_trunc('day', time)::TIMESTAMP AS step, round(100 * sum(rate), 3) AS cpu_pct FROM {RATE} r GROUP BY symbol_id, date_trunc('day', time)")
def _cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = monitoring.counter_rate(_counter(spark, sf_dir), ["symbol_id"], 86_400, tie="event_id", digits=2)
    return rate.groupBy("symbol_id", F.date_trunc("day", "time").cast("timestamp_ntz").alias("step")).agg(F.round(100 * F.sum("rate"), 3).alias("cpu_pct"))


@query("instant_last", f"SELECT symbol_id, max_by(v, time) AS value FROM {COUNTER} c WHERE time <= TIMESTAMP '2024-01-15 00:00:00' AND time > TIMESTAMP '2024-01-14 00:00:00' GROUP BY symbol_id")
def _instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _counter(spark, sf_dir)
    return monitoring.instant_last(rows, ["symbol_id"], "2024-01-15 00:00:00", minutes=60 * 24)


def _every(seconds: int, reach: int) -> str:
    """SQL: each sample with every step of which the window of ``reach`` seconds holds it."""
    return f"(SELECT s.*, first + k * INTERVAL {seconds} SECOND AS step FROM (SELECT *, time_bucket(INTERVAL {seconds} SECOND, time - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL {seconds} SECOND AS first FROM {COUNTER} c) s, range({reach // seconds + 1}) r(k) WHERE first + k * INTERVAL {seconds} SECOND < time + INTERVAL {reach} SECOND)"


@query("instant_steps", f"SELECT symbol_id, step, arg_max(v, struct_pack(t := time, e := event_id)) AS value FROM {_every(60, 300)} x GROUP BY symbol_id, step")
def _instant_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series at every minute that has a sample in the five minutes before."""
    return monitoring.instant_range(_counter(spark, sf_dir), ["symbol_id"], 60, tie="event_id")


RATE_STEPS_SQL = f"""SELECT symbol_id, step, round(grown * (sampled + least(CASE WHEN ahead < mean * 1.1 THEN ahead ELSE mean / 2 END, CASE WHEN grown > 0 AND first >= 0 THEN sampled * first / grown END) + CASE WHEN behind < mean * 1.1 THEN behind ELSE mean / 2 END) / sampled / 86400, 9) AS rate
FROM (SELECT symbol_id, step, last - first + coalesce(fixes, 0) AS grown, first, epoch_us(till) - epoch_us(since) AS sampled, (epoch_us(till) - epoch_us(since)) / (n - 1) AS mean, epoch_us(since) - epoch_us(step) + 86400000000 AS ahead, epoch_us(step) - epoch_us(till) AS behind
  FROM (SELECT symbol_id, step, min(time) AS since, max(time) AS till, arg_min(v, time) AS first, arg_max(v, time) AS last, count(*) AS n, sum(CASE WHEN time > since THEN CASE WHEN v < p THEN p END END) AS fixes
    FROM (SELECT *, min(time) OVER (PARTITION BY symbol_id, step) AS since, lag(v) OVER (PARTITION BY symbol_id, step ORDER BY time) AS p FROM (SELECT symbol_id, step, time, arg_max(v, event_id) AS v FROM {_every(21600, 86400)} e GROUP BY symbol_id, step, time) u) w GROUP BY symbol_id, step) g WHERE n > 1) x"""


@query("rate_steps", RATE_STEPS_SQL)
def _rate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate over a day at every sixth hour, extrapolated to the window's bounds."""
    found = monitoring.rate_range(_counter(spark, sf_dir), ["symbol_id"], 21_600, 86_400, tie="event_id")
    return found.select("symbol_id", "step", F.round("rate", 9).alias("rate"))


@query("schema_cast", "SELECT CAST(time AS TIMESTAMP) AS time, symbol AS ticker, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM [daily]")
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_daily(spark, sf_dir).withColumnRenamed("symbol", "ticker")
    return ingest.conform(bars, StructType.fromDDL("time timestamp_ntz, ticker string, open double, high double, low double, close double, volume bigint"))


PENDING_SQL = f"SELECT symbol_id, min(time) AS start, max(time) AS \"end\" FROM (SELECT *, sum(CASE WHEN v < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol_id ORDER BY time) AS span FROM {COUNTER} c) s WHERE v < 50 GROUP BY symbol_id, span HAVING max(time) >= min(time) + INTERVAL 5 MINUTE"


@query("alert_for_5m", PENDING_SQL)
def _alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.pending(_counter(spark, sf_dir), ["symbol_id"], F.col("value") < 50, 5)


INSTANTS = f"(SELECT symbol_id, step, arg_max(v, struct_pack(t := time, e := event_id)) AS v FROM {_every(60, 300)} x GROUP BY symbol_id, step)"
LIFE_SQL = f"""WITH i AS {INSTANTS}, s AS (SELECT symbol_id, min(step) AS start, max(step) + INTERVAL 1 MINUTE AS "end" FROM (SELECT *, step - row_number() OVER (PARTITION BY symbol_id ORDER BY step) * INTERVAL 1 MINUTE AS span FROM i WHERE v > 50) o GROUP BY symbol_id, span)
SELECT s.symbol_id, start, CASE WHEN start + INTERVAL 2 MINUTE < "end" THEN start + INTERVAL 2 MINUTE END AS firing, "end", CASE WHEN start + INTERVAL 2 MINUTE < "end" THEN 'resolved' ELSE 'cancelled' END AS state, CASE WHEN i.step IS NULL THEN 'no data' ELSE 'ok' END AS reason FROM s LEFT JOIN i ON i.symbol_id = s.symbol_id AND i.step = s."end\""""


@query("alert_lifecycle", LIFE_SQL)
def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts over 50 that fire after two minutes, evaluated each minute."""
    return monitoring.alert_intervals(_counter(spark, sf_dir), ["symbol_id"], 50, 120, tie="event_id")


from tidemark.plans import frames, operations, trading  # noqa: E402, F401  they register their queries
