import datetime

from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import ingest, monitoring, quality, rollup, text, universe
from tidemark.plans import catalogue, operations
from tidemark.sources import market
from tidemark.sources.shared import csv_members, inventory, scan, shared_path
from tidemark.streaming import bars as streams

SF = "/root/testdata/sf0.001"


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_bad_snapshot_closes_nothing(spark):
    current = spark.range(30).withColumnRenamed("id", "symbol_id")
    new, gone = universe.sync(current.where("symbol_id >= 20").union(spark.range(100, 101)), current, "symbol_id")
    assert rows_of(new) == [(100,)] and gone.count() == 20
    new, gone = universe.sync(current.where("symbol_id >= 21").union(spark.range(100, 101)), current, "symbol_id")
    assert rows_of(new) == [(100,)] and gone.isEmpty()
    new, gone = universe.sync(current.where("false"), current.where("false"), "symbol_id")
    assert new.isEmpty() and gone.isEmpty()


def test_loading_with_warm_up(spark):
    days = [datetime.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12)]
    bars = spark.createDataFrame([(s, datetime.datetime.combine(d, datetime.time())) for s in (1, 2, 3, 4) for d in days], "symbol_id long, time timestamp_ntz")
    members = spark.createDataFrame(
        [("x", 1, datetime.date(2023, 1, 1), None), ("x", 2, days[6], days[8]), ("x", 3, days[0], days[3]), ("x", 4, days[0], datetime.date(2024, 1, 10)), ("y", 4, days[0], None)],
        "index_code string, symbol_id long, entry_date date, exit_date date")
    calendar = universe.trading_days(spark.createDataFrame([(d,) for d in days], "day date"))
    got = rows_of(universe.load(bars, members, calendar, "symbol_id", "2024-01-08", "2024-01-11", 2).select("symbol_id", F.to_date("time")))
    want = [(1, d) for d in days[2:8]] + [(2, d) for d in days[4:8]] + [(4, d) for d in days[2:8]]
    assert got == sorted(want)


def test_weekdays_without_holidays(spark):
    off = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "day date")
    assert [r[0].day for r in universe.weekdays(spark, "2023-12-30", "2024-01-07", off).orderBy("day").collect()] == [2, 3, 4, 5]


def test_intervals_of_ties_repeats_and_nothing(spark):
    d = [datetime.date(2000, 1, k) for k in range(1, 9)]
    changes = [("a", "ADD", d[0]), ("a", "ADD", d[1]), ("a", "REMOVE", d[2]), ("a", "REMOVE", d[3]), ("a", "ADD", d[4]), ("b", "REMOVE", d[0]), ("b", "ADD", d[5])]
    schema = "ticker string, action string, effective_date date"
    assert sorted(universe.intervals(spark.createDataFrame(changes, schema)).collect(), key=str) == sorted([("a", d[0], d[2]), ("a", d[4], None), ("b", d[5], None)], key=str)
    assert universe.intervals(spark.createDataFrame([], schema)).isEmpty()


def test_upserts_of_nulls_repeats_and_nothing(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None)], "k long, open double")
    new = spark.createDataFrame([(1, 9.0, 0), (3, 5.0, 1), (3, 4.0, 2), (4, None, 3)], "k long, open double, no int")
    assert sorted(ingest.upsert_ignore(old, new, ["k"], arrival="no").collect(), key=str) == sorted([(1, 1.0), (2, None), (3, 5.0)], key=str)
    assert ingest.upsert_ignore(old, new.where("false"), ["k"]).count() == 2 and ingest.upsert_ignore(old.where("false"), new, ["k"], arrival="no").count() == 2


def test_exports_replace_only_their_partitions(spark):
    path = shared_path(spark, "export")
    bars = market.bars_daily(spark, SF)
    ingest.export_year(bars, path, 1997)
    ingest.export_year(bars.where("month(time) = 1"), path, 1998)
    ingest.export_year(bars, path, 1998)
    back = spark.read.parquet(path)
    assert back.count() == bars.where("year(time) in (1997, 1998)").count()
    assert {r["folder"] for r in inventory(spark, path).collect()} == {"year=1997", "year=1998"}
    assert sum(r["files"] for r in inventory(spark, path).collect()) == len(back.inputFiles())
    months = shared_path(spark, "export")
    ingest.export_months(bars, months)
    assert spark.read.parquet(months).count() == bars.count()


def test_scan_of_missing_and_empty_folders(spark, tmp_path):
    try:
        scan(spark, str(tmp_path / "none"), "a long")
        raise AssertionError
    except FileNotFoundError:
        pass
    (tmp_path / "empty").mkdir()
    found = scan(spark, str(tmp_path / "empty"), "a long")
    assert found.columns == ["a"] and found.isEmpty()


def test_member_lists(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Ticker,Name,Sector\n abc ,A company,Energy \n,No ticker,Energy\nxyz,,Mining\n", encoding="utf-8")
    assert sorted(csv_members(spark, str(tmp_path / "m.csv")).collect(), key=str) == [("ABC", "A company", "Energy"), ("XYZ", None, "Mining")]
    assert csv_members(spark, str(tmp_path / "m.csv"), sector="Energy").count() == 1


def test_bars_of_equal_times_by_the_tie(spark):
    rows = [(1, at(1), 5.0, 1, 2), (1, at(1), 3.0, 1, 1), (1, at(1), 4.0, 1, 3)]
    bar = rollup.ohlcv(spark.createDataFrame(rows, "symbol_id long, time timestamp_ntz, price double, size long, event_id long"), "symbol_id", F.date_trunc("hour", "time"), tie="event_id").first()
    assert (bar["open"], bar["close"], bar["bar_count"]) == (3.0, 4.0, 3)


def test_refresh_fills_and_repairs_a_rollup(spark):
    source = spark.createDataFrame([(1, at(1, h), 1.0) for h in range(6)], "symbol_id long, time timestamp_ntz, price double")
    build = lambda rows: rows.groupBy("symbol_id", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("bucket")).agg(F.sum("price").alias("total"))
    empty = build(source.where("false"))
    first = rollup.refresh(empty, source, "2024-01-01 01:00:00", "2024-01-01 04:00:00", build)
    assert rows_of(first.select(F.hour("bucket"), "total")) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    late = source.union(spark.createDataFrame([(1, at(1, 2), 5.0), (1, at(1, 3), 7.0)], source.schema))
    again = rollup.refresh(first, late, "2024-01-01 03:00:00", "2024-01-01 05:00:00", build)
    assert rows_of(again.select(F.hour("bucket"), "total")) == [(1, 1.0), (2, 1.0), (3, 8.0), (4, 1.0)]


def test_streams_close_buckets_and_drop_late_rows(spark, tmp_path):
    schema = "symbol_id long, time timestamp, price double, size long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [[(1, at(1, 0, 5), 1.0, 1), (1, at(1, 0, 50), 3.0, 1), (1, at(1, 4), 9.0, 1)], [(1, at(1, 0, 30), 7.0, 1), (1, at(1, 9), 2.0, 1)]]
    found = []
    for part in steps:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run = streams.stream_ohlcv(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        found.append(rows_of(spark.read.parquet(out).select(F.hour("bucket"), "open", "close", "bar_count")))
    assert found[0] == [(0, 1.0, 3.0, 2)]
    assert found[1] == [(0, 1.0, 3.0, 2), (4, 9.0, 9.0, 1)]


def test_streamed_hours_are_those_of_the_batch(spark):
    got = {(r["symbol_id"], r["bucket"].replace(tzinfo=None)): r["bar_count"] for r in operations._stream(spark, SF).collect()}
    want = {(r["symbol_id"], r["bucket"]): r["bar_count"] for r in catalogue.FOUND["ohlcv_1h"](spark, SF).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == n for k, n in got.items())


def test_alert_states_levels_and_absence(spark):
    values = spark.createDataFrame([(1, None), (2, 5.0), (3, 10.0), (4, float("nan"))], "id long, v double")
    assert rows_of(monitoring.alert_state(values, "v", 5.0).select("id", "state")) == [(1, "ok"), (2, "ok"), (3, "alerting"), (4, "error")]
    shares = spark.createDataFrame([(79.9,), (80.0,), (90.0,)], "p double")
    assert [r[0] for r in shares.orderBy("p").select(monitoring.level(F.col("p"))).collect()] == ["ok", "warning", "critical"]
    samples = spark.createDataFrame([("a", at(1, 0, 1)), ("b", at(1, 0, 9))], "name string, time timestamp_ntz")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert rows_of(monitoring.absent(names, samples, ["name"], "2024-01-01 00:10:00", 3)) == [("a",), ("c",)]
    assert monitoring.absent(names, samples, ["name"], "2024-01-01 00:10:00", 3, whole=True).isEmpty()
    assert monitoring.absent(names, samples, ["name"], "2024-01-02 00:10:00", 3, whole=True).count() == 3


def test_pending_alerts_break_at_gaps_in_the_condition(spark):
    rows = [("a", at(1, 0, m), v) for m, v in ((0, 1.0), (3, 1.0), (6, 1.0), (7, 9.0), (8, 1.0), (10, None), (11, 1.0), (16, 1.0))]
    found = monitoring.pending(spark.createDataFrame(rows, "name string, time timestamp_ntz, value double"), ["name"], F.col("value") < 5, 5)
    assert [(r["start"].minute, r["end"].minute) for r in found.orderBy("start").collect()] == [(0, 6), (11, 16)]


def test_counter_rate_with_a_restart(spark):
    rows = [("a", at(1, 0, m), v) for m, v in ((0, 10.0), (1, 40.0), (2, 5.0), (3, 25.0))]
    found = monitoring.counter_rate(spark.createDataFrame(rows, "name string, time timestamp_ntz, value double"), ["name"], 120)
    assert [r["rate"] * 120 for r in found.orderBy("time").collect()] == [0.0, 30.0, 35.0, 25.0]


def test_quality_of_nulls_and_nothing(spark):
    bars = spark.createDataFrame([("a", 1, None), ("a", 2, -1.0), ("a", 3, 0.0), ("b", 1, 2.0)], "symbol string, time long, close double")
    assert [(r["symbol"], r["n"], r["first_bad"]) for r in quality.nonpositive(bars, "symbol", "close").collect()] == [("a", 2, [2, 3])]
    assert rows_of(quality.tally(bars, "symbol", F.col("close").isNull())) == [("a", 1), ("b", 0)]
    assert quality.nonpositive(bars.where("false"), "symbol", "close").isEmpty() and quality.tally(bars.where("false"), "symbol", F.col("close") > 0).isEmpty()


def test_texts_of_dates_sections_and_tables(spark):
    docs = spark.createDataFrame([(1, "from 5 June 2020 on"), (2, "31 June 2020"), (3, None), (4, ""), (5, "on 1 may 1999, 2 May 1999")], "doc_id long, text string")
    assert [r[0] and r[0].isoformat() for r in docs.orderBy("doc_id").select(text.date_in(F.col("text"))).collect()] == ["2020-06-05", None, None, None, "1999-05-01"]
    told = spark.createDataFrame([(1, "ABC\nAdditions\nABC\nnot one\nDeletions\n XYZ \n"), (2, None)], "doc_id long, text string")
    assert rows_of(text.section_changes(told, "doc_id", "text")) == [(1, 2, "ABC", "ADD"), (1, 5, "XYZ", "REMOVE")]
    tables = spark.createDataFrame([(1, [["Code", "Additions"], ["1", "ABC", "XYZ"], ["total"]]), (2, None), (3, []), (4, [["Names"], ["ABC"]]), (5, [["REMOVALS", None], [None, "QQ"]])], "doc_id long, cells array<array<string>>")
    assert rows_of(text.table_changes(tables, "doc_id", "cells")) == [(1, 1, "ABC", "ADD"), (5, 1, "QQ", "REMOVE")]


def test_links_are_joined_to_their_page(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a/b.html", '<a href="x.PDF"><a href="/y.pdf"><a href="http://k/z.pdf"><a href="x.PDF"><a href="q.htm">'), (2, None, None)], "page_id long, url string, html string")
    assert [r["link"] for r in text.links(pages, r"\.pdf").orderBy("link").collect()] == ["http://h.org/a/x.PDF", "http://h.org/y.pdf", "http://k/z.pdf"]


def test_backups(spark):
    names = spark.createDataFrame([("db-20240103",), ("db-20240101",)], "name string")
    assert rows_of(ingest.newest(names)) == [("db-20240103",)] and rows_of(ingest.newest(names, stamp="20240101")) == [("db-20240101",)]
    old = spark.createDataFrame([("db", "a", at(1).date()), ("db", "b", at(9).date()), ("weekly", "c", at(1).date()), ("other", "d", at(1).date())], "kind string, name string, day date")
    assert [r["name"] for r in ingest.expired(old, "2024-01-10", {"db": 7, "weekly": 28}).collect()] == ["a"]


def test_strict_averages_wait_for_full_windows(spark):
    bars = spark.createDataFrame([("a", k, v) for k, v in enumerate((1.0, None, 3.0, 5.0))], "symbol string, time long, close double")
    got = bars.select("time", ind.sma(F.col("close"), ind.series("symbol"), 2).alias("s")).orderBy("time").collect()
    assert [r["s"] for r in got] == [None, None, None, 4.0]
