import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, metrics
from tidemark.plans import catalogue, trading

DAYS = [datetime.datetime(2020, 1, 1) + datetime.timedelta(days=k) for k in range(40)]
SCHEMA = "run string, symbol string, time timestamp_ntz, open double, close double, entry boolean, exit boolean"


def made(seed, missing=0.1):
    rng, rows = random.Random(seed), []
    for run in ("a", "b"):
        for symbol in "pqrst":
            for day in DAYS:
                if rng.random() < 0.1:
                    continue
                entry = rng.random() < 0.15
                blank = lambda v: None if rng.random() < missing else v
                rows.append((run, symbol, day, blank(rng.choice((0.0, 5.0, 10.0, 20.0))), blank(rng.uniform(5, 20)), entry, not entry and rng.random() < 0.15))
    return rows


def plain(rows, capital=1000.0, fee=0.01, carry=False, booking="signal"):
    """The run day by day: exits, entries, mark; orders fill at the next open of their symbol and are booked on the signal's or the fill's day."""
    equity, trades = {}, []
    for run in sorted({r[0] for r in rows}):
        series, at = {}, {}
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: r[2]):
            series.setdefault(r[1], []).append(r)
        for s, own in series.items():
            closes = [b[4] for b in own]
            for k, bar in enumerate(own):
                known = [c for c in closes[: k + 1] if c is not None]
                mark = (known[-1] if known else None) if carry else bar[4]
                if booking == "signal":
                    at.setdefault(bar[2], {})[s] = (bar[5], bar[6], own[k + 1][3] if k + 1 < len(own) else None, mark, mark)
                else:
                    earlier = [c for c in closes[:k] if c is not None]
                    at.setdefault(bar[2], {})[s] = (k > 0 and own[k - 1][5], k > 0 and own[k - 1][6], bar[3], mark, earlier[-1] if earlier else None)
        cash, held = capital, {}
        for day, today in sorted(at.items()):
            for s in sorted(today):
                _, leave, fill, _, _ = today[s]
                if leave and s in held and fill is not None:
                    shares, paid, since = held.pop(s)
                    cash += shares * fill * (1 - fee)
                    trades.append((run, s, since, day, paid, fill, fill * (1 - fee) / (paid * (1 + fee)) - 1))
            new = [s for s in sorted(today) if today[s][0] and s not in held]
            total = cash + sum(n * today[s][4] for s, (n, _, _) in held.items() if s in today and today[s][4] is not None)
            share = total / (len(held) + len(new)) if new else 0
            for s in new:
                fill = today[s][2]
                if fill is None or fill <= 0:
                    continue
                cost = share * (1 - fee)
                cost = cost if cost <= cash else cash * (1 - fee)
                if cost > 0:
                    held[s] = (cost / fill, fill, day)
                    cash -= cost * (1 + fee)
            equity[run, day] = (cash + sum(n * today[s][3] for s, (n, _, _) in held.items() if s in today and today[s][3] is not None), sum(s in today for s in held))
    return equity, trades


def check(equity, trades, want, sold):
    got = {(r["run"], r["time"]): (r["value"], r["positions"]) for r in equity.collect()}
    assert got.keys() == want.keys() and len(sold) > 5
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)
    found = sorted((r["run"], r["symbol"], r["entry_time"], r["exit_time"], r["entry_fill"], r["exit_fill"], r["net_return"]) for r in trades.collect())
    assert [f[:6] for f in found] == [t[:6] for t in sorted(sold)]
    assert [f[6] for f in found] == pytest.approx([t[6] for t in sorted(sold)])


@pytest.mark.parametrize("seed, carry, booking", [(1, False, "signal"), (2, False, "fill"), (3, True, "signal"), (4, True, "fill")])
def test_portfolio_matches_a_plain_loop(spark, seed, carry, booking):
    rows = made(seed)
    equity, trades = backtest.portfolio(spark.createDataFrame(rows, SCHEMA).repartition(3), "run", "symbol", capital=1000.0, fee=0.01, carry=carry, booking=booking)
    check(equity, trades, *plain(rows, carry=carry, booking=booking))


def test_a_market_of_two_thousand_symbols(spark):
    """Nearly every day has orders, but the fold sees few of the bars."""
    n, days = 2000, 30
    bars = spark.range(n * days).select(F.lit("a").alias("run"), F.format_string("s%04d", F.col("id") % n).alias("symbol"), (F.lit(DAYS[0]) + F.make_interval(days=(F.col("id") / n).cast("int"))).alias("time"), F.xxhash64("id").alias("h"))
    price = lambda k: 5 + F.pmod(F.col("h"), F.lit(k)) / 10
    rows = bars.select("run", "symbol", "time", price(97).alias("open"), price(89).alias("close"), (F.pmod("h", F.lit(101)) == 0).alias("entry"), (F.pmod("h", F.lit(17)) == 1).alias("exit"))
    want, sold = plain([tuple(r) for r in rows.collect()])
    check(*backtest.portfolio(rows, "run", "symbol", capital=1000.0, fee=0.01), want, sold)
    seen = backtest.candidates(backtest._shifted(rows, "run", "symbol", False, "signal"), "run", "symbol").count()
    assert len({t[2] for t in sold}) > 20 and seen < 0.25 * n * days


def test_the_queries_against_the_plain_loop(spark):
    """The clipped run and the grid of Sharpe ratios, from the signals up."""
    sf = "/root/testdata/sf0.001"
    signals = trading._signals(spark, sf).select("run", "symbol", "time", "open", "close", "entry", "exit")
    equity, _ = plain([tuple(r) for r in signals.collect()], capital=100_000.0, fee=0.001)
    got = {f"{r['n_fast']}/{s}": r[str(s)] for r in catalogue.FOUND["sharpe_grid"](spark, sf).collect() for s in trading.SLOWS}
    for run in {r for r, _ in equity}:
        values = [v for (name, _), (v, _) in sorted(equity.items()) if name == run]
        returns = [b / a - 1 for a, b in zip(values, values[1:])]
        mean, spread = statistics.mean(returns), statistics.stdev(returns)
        assert got[run] == (pytest.approx((mean - 0.043 / 252) / spread * math.sqrt(252), abs=1e-4) if spread else None)
    assert len(got) == len({r for r, _ in equity})
    clipped = trading.clipped_signals(spark, sf).select("run", "symbol_id", "time", "open", "close", "entry", "exit")
    want, _ = plain([tuple(r) for r in clipped.collect()], capital=100_000.0, fee=0.001)
    found = {(r["run"], r["time"]): r["value"] for r in catalogue.FOUND["portfolio_clipped"](spark, sf).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v) for k, (v, _) in want.items())


def test_portfolio_without_orders_or_rows(spark):
    rows = [("a", "p", day, 1.0, 2.0, False, False) for day in DAYS[:3]]
    equity, trades = backtest.portfolio(spark.createDataFrame(rows, SCHEMA), "run", "symbol")
    assert [r["value"] for r in equity.collect()] == [100_000.0] * 3 and trades.isEmpty()
    equity, trades = backtest.portfolio(spark.createDataFrame([], SCHEMA), "run", "symbol")
    assert equity.isEmpty() and trades.isEmpty()


def test_fill_of_zero_opens_nothing(spark):
    rows = [("a", "p", DAYS[0], 1.0, 1.0, True, False), ("a", "p", DAYS[1], 0.0, 1.0, False, False)]
    equity, trades = backtest.portfolio(spark.createDataFrame(rows, SCHEMA), "run", "symbol")
    assert {(r["value"], r["positions"]) for r in equity.collect()} == {(100_000.0, 0)} and trades.isEmpty()


def test_cash_short_of_an_allocation(spark):
    """Two enter, then a third whose share is larger than the cash there is."""
    rows = [("a", s, day, 10.0, 10.0, (s, k) in {("p", 0), ("q", 2)}, False) for s in "pq" for k, day in enumerate(DAYS[:5])]
    equity, _ = backtest.portfolio(spark.createDataFrame(rows, SCHEMA), "run", "symbol", capital=1000.0, fee=0.01)
    want, _ = plain(rows)
    assert {r["time"]: pytest.approx(r["value"]) for r in equity.collect()} == {d: v for (_, d), (v, _) in want.items()}


def test_summary_with_trades(spark):
    curve = spark.createDataFrame([(run, DAYS[k], 100.0 + k) for run in "ab" for k in range(5)], "run string, time timestamp_ntz, value double")
    trades = spark.createDataFrame([("a", 0.1), ("a", -0.05), ("a", 0.02)], "run string, net_return double")
    rows = {r["run"]: r for r in metrics.summary(curve, "run", trades=trades).collect()}
    assert (rows["a"]["num_trades"], rows["a"]["win_rate"], rows["a"]["profit_factor"], rows["a"]["avg_trade"]) == (3, 0.6667, 2.4, 0.023333)
    assert rows["b"]["num_trades"] is None and rows["b"]["start_date"] == DAYS[0].date() and rows["b"]["end_date"] == DAYS[4].date() and rows["b"]["risk_free_rate"] == 0.043


def test_warm_up_has_no_signal(spark):
    rows = [("a", "p", DAYS[k], 1.0, float(k % 7), k == 1, False) for k in range(20)]
    assert backtest.warmup_violations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "5 as n_slow"), ["run", "symbol"], "n_slow").count() == 1
    bars = spark.createDataFrame(rows, SCHEMA).select("symbol", "time", "open", "close")
    assert backtest.warmup_violations(backtest.signal_grid(bars, "symbol", [2], [4]), ["symbol"], "n_slow").isEmpty()
