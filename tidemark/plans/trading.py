"""Universes with warm-up, portfolio runs, trades and samples side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.functions.indicators import crossings, series, sma_partial
from tidemark.operators import backtest, metrics, rollup, universe
from tidemark.plans.registry import query
from tidemark.sources.market import bars_daily, half_open, listings, ticks

FASTS, SLOWS = [10, 20, 30], [50, 100]
START, END, WARMUP = "2024-01-10", "2024-01-25", 3
LISTED = "(SELECT symbol_id, day + CAST(symbol_id % 7 AS INTEGER) AS entry_date, CASE WHEN symbol_id % 3 = 0 THEN day + CAST(symbol_id % 7 + 12 AS INTEGER) END AS exit_date FROM (SELECT symbol_id, CAST(min(time) AS DATE) AS day FROM [ticks] GROUP BY symbol_id) f)"
DAYS = "(SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT CAST(time AS DATE) AS day FROM [ticks]) d)"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rollup.ohlcv(ticks(spark, sf_dir), "symbol_id", F.date_trunc("day", "time").cast("timestamp_ntz"), tie="event_id")
    return made.withColumnRenamed("bucket", "time")


UNIVERSE_SQL = f"""SELECT b.symbol_id, CAST(b.day AS TIMESTAMP) AS time, b.close FROM (SELECT symbol_id, CAST(time AS DATE) AS day, max_by(price, time) AS close FROM [ticks] GROUP BY symbol_id, CAST(time AS DATE)) b
  JOIN (SELECT l.symbol_id, exit_date, coalesce((SELECT day FROM {DAYS} d WHERE d.k = (SELECT max(k) FROM {DAYS} e WHERE e.day <= greatest(entry_date, DATE '{START}')) - {WARMUP}), greatest(entry_date, DATE '{START}')) AS since
    FROM {LISTED} l WHERE entry_date <= DATE '{END}' AND (exit_date IS NULL OR exit_date > DATE '{START}')) s ON s.symbol_id = b.symbol_id
  WHERE b.day >= since AND b.day <= DATE '{END}' AND (exit_date IS NULL OR b.day < exit_date)"""


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    calendar = universe.trading_days(ticks(spark, sf_dir).select(F.to_date("time").alias("day")))
    return universe.load(bars, listings(spark, sf_dir), calendar, "symbol_id", START, END, WARMUP)


@query("universe_bars", UNIVERSE_SQL)
def _universe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select("symbol_id", "time", "close")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtest.signal_grid(bars_daily(spark, sf_dir), "symbol", FASTS, SLOWS)
    return found.withColumn("run", F.concat_ws("/", "n_fast", "n_slow"))


def _portfolio(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return backtest.portfolio(_signals(spark, sf_dir), "run", "symbol")


@query("portfolio_equity")
def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _portfolio(spark, sf_dir)[0]


@query("portfolio_trades")
def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _portfolio(spark, sf_dir)[1]


def clipped_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals on the whole universe with its warm-up, then those from the start day on."""
    bars = _universe(spark, sf_dir).select("symbol_id", "time", "open", "close")
    signals = backtest.signal_grid(bars, "symbol_id", [2], [3], mode="compat").withColumn("run", F.concat_ws("/", "n_fast", "n_slow"))
    return signals.where(half_open(F.col("time"), START, END))


@query("portfolio_clipped")
def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.portfolio(clipped_signals(spark, sf_dir), "run", "symbol_id")[0]


@query("portfolio_strict")
def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders booked on the day of their fill, the last close where one is missing."""
    return backtest.portfolio(_signals(spark, sf_dir), "run", "symbol", carry=True, booking="fill")[0]


@query("sharpe_grid")
def _sharpe_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    equity = metrics.with_returns(_equity(spark, sf_dir), "run")
    each = equity.groupBy("run").agg(F.round(metrics.sharpe(F.col("r"), 0.043), 4).alias("sharpe")).select(F.split_part("run", F.lit("/"), F.lit(1)).alias("n_fast"), F.split_part("run", F.lit("/"), F.lit(2)).alias("n_slow"), "sharpe")
    return each.groupBy("n_fast").pivot("n_slow", [str(s) for s in SLOWS]).agg(F.first("sharpe"))


@query("backtest_summary")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: crossovers, portfolio, trades and statistics for each pair of spans."""
    equity, trades = _portfolio(spark, sf_dir)
    return metrics.summary(equity, "run", trades=trades)


def _sample(name: str, rows: DataFrame, sample: Column) -> DataFrame:
    found = metrics.summary(rows.where(sample).withColumnRenamed("close", "value"), "symbol")
    return found.select(F.lit(name).alias("sample"), "symbol", "total_return", "max_drawdown", "sharpe", "n")


def _sample_sql(name: str, sign: str) -> str:
    rows = f"(SELECT symbol, time, close FROM [daily] WHERE time {sign} DATE '1999-01-01')"
    curve = f"(SELECT symbol, time, close AS v, close / lag(close) OVER w - 1 AS r, (close - max(close) OVER (w ROWS UNBOUNDED PRECEDING)) / max(close) OVER (w ROWS UNBOUNDED PRECEDING) AS d FROM {rows} b WINDOW w AS (PARTITION BY symbol ORDER BY time))"
    return f"SELECT '{name}' AS sample, symbol, round(max_by(v, time) / min_by(v, time) - 1, 4) AS total_return, round(-min(d), 4) AS max_drawdown, round((avg(r) - 0.043 / 252) / stddev_samp(r) * sqrt(252), 4) AS sharpe, count(*) AS n FROM {curve} c GROUP BY symbol"


@query("is_oos_compare", f"{_sample_sql('IS', '<')} UNION ALL {_sample_sql('OOS', '>=')}")
def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, split = bars_daily(spark, sf_dir), F.lit("1999-01-01").cast("timestamp_ntz")
    return reduce(DataFrame.unionByName, [_sample("IS", bars, F.col("time") < split), _sample("OOS", bars, F.col("time") >= split)])


@query("warmup_check", "SELECT CAST(count(*) AS BIGINT) AS violations FROM (SELECT 1 AS x WHERE false) n")
def _warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No signal before the slow average is known: the count must be zero."""
    return backtest.warmup_violations(_signals(spark, sf_dir), ["run", "symbol"], "n_slow").agg(F.count("*").alias("violations"))


EARLY_SQL = """SELECT symbol, CAST(count(*) AS BIGINT) AS violations FROM (SELECT symbol, k, fast > slow AND lag(fast) OVER w <= lag(slow) OVER w AS up, fast < slow AND lag(fast) OVER w >= lag(slow) OVER w AS down
  FROM (SELECT symbol, time, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS 9 PRECEDING) AS fast, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS 49 PRECEDING) AS slow FROM [daily]) a WINDOW w AS (PARTITION BY symbol ORDER BY time)) b WHERE k < 50 AND (up OR down) GROUP BY symbol"""


@query("warmup_breaches", EARLY_SQL)
def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages that don't wait for their window signal too early: the check must count those."""
    w = series("symbol")
    rows = bars_daily(spark, sf_dir).select("symbol", "time", sma_partial(F.col("close"), w, 10).alias("fast"), sma_partial(F.col("close"), w, 50).alias("slow"))
    entry, leave = crossings(F.col("fast"), F.col("slow"), w)
    signals = rows.select("symbol", "time", F.lit(50).alias("n_slow"), entry.alias("entry"), leave.alias("exit"))
    return backtest.warmup_violations(signals, ["symbol"], "n_slow").groupBy("symbol").agg(F.count("*").alias("violations"))


ATR_SQL = """WITH RECURSIVE b AS (SELECT symbol, time, greatest(high - low, abs(high - p), abs(low - p)) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS p FROM [daily]) a),
e AS (SELECT symbol, time, k, tr AS v FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.time, b.k, b.tr / 14 + e.v * 13 / 14 FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1)
SELECT symbol, time, CASE WHEN k >= 14 THEN round(v, 3) END AS atr_wilder FROM e"""


@query("atr_wilder", ATR_SQL)
def _atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.atr_wilder(bars_daily(spark, sf_dir), "symbol").select("symbol", "time", F.round("atr_wilder", 3).alias("atr_wilder"))
