"""SQL that checks queries, over the tables named in braces and views of them in brackets."""

from __future__ import annotations

DAILY = """(SELECT o_orderpriority AS symbol, o_orderdate AS time, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM {orders} GROUP BY o_orderpriority, o_orderdate)"""
TICKS = "(SELECT ts AS time, user_id AS symbol_id, value AS price, event_id % 100 + 1 AS size, event_type AS kind, event_id FROM {events})"
MEMBERS = """(SELECT c_mktsegment AS index_code, c_custkey AS symbol_id, entry_date, CASE WHEN c_custkey % 3 <> 0 THEN last END AS exit_date
  FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS entry_date, CAST(max(o_orderdate) AS DATE) AS last FROM {orders} GROUP BY o_custkey) s
  JOIN {customer} c ON s.o_custkey = c.c_custkey WHERE c_custkey % 3 = 0 OR last > entry_date)"""
SYMBOLS = """(SELECT c_custkey AS symbol_id, c_name AS ticker, n_name AS exchange, r_name AS market, c_mktsegment AS sec_type
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"""

RAW = {
    # scans, projections, filters
    "scan_bars_range": "SELECT symbol, time, open, high, low, close, volume FROM [daily] WHERE symbol IN ('1-URGENT', '2-HIGH') AND time >= DATE '1996-01-01' AND time < DATE '1997-01-01'",
    "scan_bars_joined": "SELECT s.ticker, t.time, t.price FROM [ticks] t JOIN [symbols] s ON t.symbol_id = s.symbol_id WHERE s.market IN ('ASIA', 'EUROPE')",
    "star_join_bars": "SELECT s.market, s.exchange, count(*) AS n, round(sum(t.price), 2) AS total FROM [ticks] t JOIN [symbols] s ON t.symbol_id = s.symbol_id GROUP BY s.market, s.exchange",
    "filter_in": "SELECT symbol_id, ticker FROM [symbols] WHERE exchange IN ('NATION_3', 'NATION_7', 'NATION_12')",
    "filter_range": "SELECT event_id, ts FROM {events} WHERE value >= 10 AND value <= 50",
    "drop_null_open": "SELECT symbol, time, open FROM (SELECT symbol, time, CASE WHEN volume > 1 THEN open END AS open, CASE WHEN volume > 1 THEN close END AS close, volume - 1 AS volume FROM [daily]) b WHERE open IS NOT NULL",
    "asx200_current": "SELECT symbol_id, entry_date FROM [members] WHERE index_code = 'BUILDING' AND exit_date IS NULL",
    "index_universe_full": "SELECT m.index_code, s.ticker, s.exchange, m.entry_date, m.exit_date FROM [members] m JOIN [symbols] s ON m.symbol_id = s.symbol_id",
    "ever_constituents": "SELECT DISTINCT s.ticker, s.exchange FROM [members] m JOIN [symbols] s ON m.symbol_id = s.symbol_id WHERE m.index_code IN ('BUILDING', 'MACHINERY')",
    "short_history": "SELECT symbol_id, count(*) AS bars FROM [ticks] GROUP BY symbol_id HAVING count(*) < 60",
    "align_semi": "SELECT DISTINCT time FROM [daily] d WHERE symbol = '1-URGENT' AND EXISTS (SELECT 1 FROM [daily] b WHERE b.symbol = '5-LOW' AND b.time = d.time)",
    # point in time
    "universe_at_date": "SELECT symbol_id FROM [members] WHERE index_code = 'BUILDING' AND entry_date <= DATE '1998-06-01' AND (exit_date IS NULL OR exit_date > DATE '1998-06-01')",
    "universe_overlap": "SELECT index_code, symbol_id, entry_date, exit_date FROM [members] WHERE entry_date <= DATE '1998-12-31' AND (exit_date IS NULL OR exit_date > DATE '1998-01-01')",
    "universe_daily_counts": "SELECT d.day, m.index_code, count(*) AS members FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM {orders}) d JOIN [members] m ON m.entry_date <= d.day AND (m.exit_date IS NULL OR m.exit_date > d.day) GROUP BY d.day, m.index_code",
    "calendar_align": "SELECT c.time, s.symbol, b.close, b.close IS NOT NULL AS has_bar FROM (SELECT DISTINCT time FROM [daily]) c CROSS JOIN (SELECT DISTINCT symbol FROM [daily]) s LEFT JOIN [daily] b ON b.time = c.time AND b.symbol = s.symbol",
    "bench_align": "SELECT a.symbol, a.time, a.close AS s, b.close AS b FROM [daily] a JOIN (SELECT time, close FROM [daily] WHERE symbol = '5-LOW') b ON a.time = b.time WHERE a.symbol <> '5-LOW' AND a.close IS NOT NULL AND b.close IS NOT NULL",
    "append_missing": "SELECT symbol_id, 'member' AS kind FROM [members] WHERE index_code = 'BUILDING' UNION ALL SELECT c_custkey AS symbol_id, 'benchmark' AS kind FROM {customer} c WHERE c_custkey <= 20 AND NOT EXISTS (SELECT 1 FROM [members] m WHERE m.index_code = 'BUILDING' AND m.symbol_id = c.c_custkey)",
    "symbols_per_day": "SELECT c.time, count(b.symbol) AS n FROM (SELECT DISTINCT time FROM [daily]) c LEFT JOIN [daily] b ON b.time = c.time AND b.volume > 1 GROUP BY c.time",
    "topk_recent": "SELECT o_orderkey, c_name, o_orderdate FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    # aggregates
    "time_bucket_day": "SELECT date_trunc('day', time) AS bucket, count(*) AS n, round(sum(price), 2) AS total FROM [ticks] GROUP BY date_trunc('day', time)",
    "time_bucket_week": "SELECT date_trunc('week', time) AS bucket, count(*) AS n FROM [ticks] GROUP BY date_trunc('week', time)",
    "first_last_agg": "SELECT symbol_id, min_by(price, struct_pack(t := time, e := event_id)) AS first_price, max_by(price, struct_pack(t := time, e := event_id)) AS last_price FROM [ticks] GROUP BY symbol_id",
    "last_bar": "SELECT symbol_id, max(time) AS last_time FROM [ticks] GROUP BY symbol_id",
    "table_counts": "SELECT 'orders' AS name, count(*) AS n FROM {orders} UNION ALL SELECT 'events', count(*) FROM {events} UNION ALL SELECT 'customer', count(*) FROM {customer} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'part', count(*) FROM {part}",
    "ratio_nullif": "SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 1) AS ratio FROM {lineitem} GROUP BY l_returnflag",
    "coverage_summary": "SELECT symbol, count(*) AS bars, min(time) AS first_bar, max(time) AS last_bar, round(avg(CAST(CASE WHEN volume = 1 THEN 1 ELSE 0 END AS DOUBLE)) * 100, 2) AS thin_pct, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_close FROM [daily] GROUP BY symbol",
    "change_counts": "SELECT action, count(*) AS n FROM (SELECT 'ADD' AS action FROM [members] UNION ALL SELECT 'REMOVE' FROM [members] WHERE exit_date IS NOT NULL) x GROUP BY action",
    "coalesce_sum": "SELECT coalesce(sum(CASE WHEN o_orderstatus = 'none' THEN o_totalprice END), 0.0) AS nothing, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0.0), 2) AS total FROM {orders}",
    "latest_per_key": "SELECT o_custkey, max_by(o_orderkey, o_orderkey + 0) AS latest FROM {orders} GROUP BY o_custkey",
    "return_histogram": "SELECT symbol, CAST(floor((r + 1) / 0.25) AS BIGINT) AS bin, count(*) AS n FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1 AS r FROM [daily]) x WHERE r IS NOT NULL GROUP BY symbol, CAST(floor((r + 1) / 0.25) AS BIGINT)",
    "label_values": "SELECT DISTINCT kind FROM [ticks]",
    "win_rate": "SELECT symbol, avg(CAST(CASE WHEN r > 0 THEN 1 ELSE 0 END AS DOUBLE)) AS win_rate, round(avg(r), 9) AS avg_trade FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY time) - 1 AS r FROM [daily]) x WHERE r IS NOT NULL GROUP BY symbol",
    # quality
    "dq_nonpositive": "SELECT c_nationkey AS symbol, count(*) AS n, list(c_custkey ORDER BY c_custkey)[1:5] AS first_bad FROM {customer} WHERE c_acctbal <= 0 GROUP BY c_nationkey",
    "dq_nulls": "SELECT symbol, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT symbol, time, CASE WHEN volume > 1 THEN open END AS open, CASE WHEN volume > 1 THEN close END AS close, volume - 1 AS volume FROM [daily]) b GROUP BY symbol",
    "dq_zero_volume": "SELECT symbol, CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT symbol, time, CASE WHEN volume > 1 THEN open END AS open, CASE WHEN volume > 1 THEN close END AS close, volume - 1 AS volume FROM [daily]) b GROUP BY symbol",
    "session_gaps": "SELECT symbol, time, CAST(missing AS BIGINT) AS missing FROM (SELECT symbol, time, k - lag(k) OVER (PARTITION BY symbol ORDER BY time) - 1 AS missing FROM (SELECT b.symbol, b.time, c.k FROM [daily] b JOIN (SELECT time, row_number() OVER (ORDER BY time) AS k FROM (SELECT DISTINCT time FROM [daily]) t) c ON b.time = c.time) x) y WHERE missing > 4",
    # windows
    "dedup_keep_last": "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) x WHERE k = 1",
    "next_open": "SELECT symbol, time, lead(open) OVER (PARTITION BY symbol ORDER BY time) AS next_open FROM [daily]",
    "rebase": "SELECT symbol, time, close / first_value(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100000 AS value FROM [daily]",
    "shift_trading_days": "SELECT min(time) AS shifted FROM (SELECT time, row_number() OVER (ORDER BY time DESC) AS k FROM (SELECT DISTINCT time FROM [daily] WHERE time <= DATE '1998-06-01') t) x WHERE k <= 55",
    "is_oos_split": "SELECT CASE WHEN time < DATE '1999-01-01' THEN 'IS' ELSE 'OOS' END AS sample, symbol, count(*) AS n FROM [daily] GROUP BY CASE WHEN time < DATE '1999-01-01' THEN 'IS' ELSE 'OOS' END, symbol",
    # ingest
    "needs_backfill": "SELECT s.symbol_id FROM [symbols] s WHERE NOT EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = s.symbol_id)",
    "sync_new": "SELECT DISTINCT o_custkey AS symbol_id FROM {orders} o WHERE o_orderdate >= DATE '1999-01-01' AND NOT EXISTS (SELECT 1 FROM [members] m WHERE m.symbol_id = o.o_custkey AND m.exit_date IS NULL)",
    "retention_filter": "SELECT symbol, time, close FROM [daily] WHERE time >= DATE '1999-01-01'",
    "partition_keys": "SELECT symbol, CAST(year(time) AS BIGINT) AS year, CAST(month(time) AS BIGINT) AS month, count(*) AS n FROM [daily] GROUP BY symbol, year(time), month(time)",
    "market_rollup": "SELECT CASE WHEN s.market IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE 'WEST' END AS market, CAST(year(t.time) AS BIGINT) AS year, count(*) AS n FROM [ticks] t JOIN [symbols] s ON t.symbol_id = s.symbol_id GROUP BY CASE WHEN s.market IN ('ASIA', 'MIDDLE EAST') THEN 'EAST' ELSE 'WEST' END, year(t.time)",
    # monitoring
    "mem_by_name": "SELECT kind AS name, date_trunc('hour', time) AS step, round(sum(price), 2) AS total FROM [ticks] GROUP BY kind, date_trunc('hour', time)",
    "disk_ratio_alert": "SELECT symbol_id, min(price) / max(price) AS ratio FROM [ticks] GROUP BY symbol_id HAVING min(price) / max(price) < 0.0015",
    "absent_3m": "SELECT u.symbol_id FROM (SELECT DISTINCT symbol_id FROM [ticks]) u WHERE NOT EXISTS (SELECT 1 FROM [ticks] t WHERE t.symbol_id = u.symbol_id AND t.time > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 3 MINUTE AND t.time <= TIMESTAMP '2024-01-15 00:00:00')",
}


def expanded(text: str) -> str:
    for name, view in (("daily", DAILY), ("ticks", TICKS), ("members", MEMBERS), ("symbols", SYMBOLS)):
        text = text.replace(f"[{name}]", view)
    return text


def for_check(text: str) -> str:
    """The text with plain table names."""
    return expanded(text).replace("{", "").replace("}", "")
