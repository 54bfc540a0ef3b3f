import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, rollup
from tidemark.sources.shared import shared_path
from tidemark.sources.stored import Stored
from tidemark.streaming import bars as streams

BAR = "symbol_id long, bucket timestamp_ntz, open double, day date"


def at(day, hour=0, minute=0):
    return datetime.datetime(2024, 1, day, hour, minute)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def bars(spark, rows):
    return spark.createDataFrame([(s, b, o, b.date(), k) for k, (s, b, o) in enumerate(rows)], BAR + ", k int").repartition(3)


def test_the_first_writer_wins_even_with_the_higher_open(spark):
    store = Stored(spark, shared_path(spark, "bars"), BAR, "day")
    keys = ["symbol_id", "bucket"]
    ingest.insert_first(store, bars(spark, [(1, at(1), 9.0), (1, at(1), 3.0), (2, at(2), None), (2, at(2), 4.0)]), keys, arrival="k")
    assert rows_of(store.read().select("symbol_id", "bucket", "open")) == [(1, at(1), 9.0), (2, at(2), 4.0)]
    ingest.insert_first(store, bars(spark, [(1, at(1), 1.0), (1, at(3), 8.0), (1, at(3), 2.0)]), keys, arrival="k")
    assert rows_of(store.read().select("symbol_id", "bucket", "open")) == [(1, at(1), 9.0), (1, at(3), 8.0), (2, at(2), 4.0)]
    # The second write holds only the day that it changed; a third that brings nothing new writes nothing.
    assert [p for p, f in store.current().items() if "write=00000002" in f] == ["2024-01-03"]
    ingest.insert_first(store, bars(spark, [(1, at(3), 1.0), (5, at(5), None)]), keys, arrival="k")
    assert store.writes() == ["00000001", "00000002"] and store.read(["2024-01-02"]).count() == 1


def test_unfinished_writes_are_not_seen(spark):
    store = Stored(spark, shared_path(spark, "bars"), BAR, "day")
    assert store.read().isEmpty() and store.writes() == []
    store.write(bars(spark, [(1, at(1), 1.0)]))
    bars(spark, [(1, at(1), 7.0)]).drop("k").withColumn("_part", F.col("day").cast("string")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("_part").parquet(f"{store.path}/write=00000002")
    assert rows_of(store.read().select("open")) == [(1.0,)]
    store.write(bars(spark, [(1, at(1), 2.0)]))
    assert store.writes() == ["00000001", "00000003"] and rows_of(store.read().select("open")) == [(2.0,)]


def test_upserts_name_the_order_of_arrival(spark):
    old, new = bars(spark, [(1, at(1), 1.0)]).drop("k"), bars(spark, [(1, at(1), 9.0), (3, at(1), 5.0), (3, at(1), 4.0), (4, at(1), None)])
    found = ingest.upsert_ignore(old, new, ["symbol_id", "bucket"], arrival="k")
    assert rows_of(found.select("symbol_id", "open")) == [(1, 1.0), (3, 5.0)]
    with pytest.raises(Exception, match="order of arrival"):
        ingest.upsert_ignore(old, new, ["symbol_id", "bucket"]).collect()


TICK = "symbol_id long, time timestamp_ntz, price double"


def made(spark):
    source, notes = (Stored(spark, shared_path(spark, n), f"{s}, bucket timestamp_ntz, part string", "part") for n, s in (("ticks", TICK), ("notes", "symbol_id long, open boolean")))
    target = Stored(spark, shared_path(spark, "hours"), "symbol_id long, bucket timestamp_ntz, total double, n long, day date", "day")
    built = []

    def build(rows):
        built.append(rows_of(rows.select("symbol_id", "bucket").distinct()))
        return rows.groupBy("symbol_id", "bucket").agg(F.sum("price").alias("total"), F.count("*").alias("n"))

    return rollup.Policy(source, notes, target, "symbol_id", build, width=3600, start=3 * 3600, end=3600), built


def totals(policy):
    return {(r["bucket"].day, r["bucket"].hour): (r["total"], r["n"]) for r in policy.target.read().collect()}


def test_a_policy_builds_changed_buckets_of_its_window_only(spark):
    policy, built = made(spark)
    load = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], TICK)
    policy.arrive(load((at(1, 8), 1.0), (at(1, 9, 30), 2.0), (at(1, 10, 59), 3.0), (at(1, 11), 4.0), (at(1, 12), 5.0)), 0)
    assert totals(policy) == {}
    # At 12:10 the window is [9:10, 11:10), that is the buckets 10 only.
    policy.refresh(at(1, 12, 10))
    assert totals(policy) == {(1, 10): (3.0, 1)}
    policy.refresh(at(1, 12, 10))
    assert len(built) == 1
    # One hour on, the next bucket; a late row in the window is taken up, one before it is left alone.
    policy.arrive(load((at(1, 10, 5), 10.0), (at(1, 9, 1), 20.0), (at(1, 11, 30), 30.0)), 1)
    policy.refresh(at(1, 13))
    assert totals(policy) == {(1, 10): (13.0, 2), (1, 11): (34.0, 2)}
    assert built[1] == [(1, at(1, 10)), (1, at(1, 11))]
    policy.arrive(load((at(1, 10, 6), 100.0), (at(1, 11, 31), 300.0)), 2)
    policy.refresh(at(1, 14))
    assert totals(policy) == {(1, 10): (13.0, 2), (1, 11): (334.0, 3), (1, 12): (5.0, 1)}
    # Stored again after a failure, a load counts once; a repair takes up what the policy left.
    policy.arrive(load((at(1, 10, 6), 100.0), (at(1, 11, 31), 300.0)), 2)
    policy.repair(at(1, 0), at(2, 0))
    assert totals(policy) == {(1, 8): (1.0, 1), (1, 9): (22.0, 2), (1, 10): (113.0, 3), (1, 11): (334.0, 3), (1, 12): (5.0, 1)}


def test_a_policy_follows_a_stream(spark, tmp_path):
    policy, _ = made(spark)
    source, clocks = str(tmp_path / "in"), [at(1, 12), at(1, 13)]
    for k, rows in enumerate([[(1, at(1, 9), 1.0), (1, at(1, 10), 2.0)], [(1, at(1, 9), 5.0), (1, at(1, 11), 7.0)]]):
        spark.createDataFrame(rows, TICK).write.mode("append").parquet(source)
        run = streams.follow(spark.readStream.schema(TICK).parquet(source), policy, clocks.__getitem__).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert totals(policy) == [{(1, 9): (1.0, 1), (1, 10): (2.0, 1)}, {(1, 9): (1.0, 1), (1, 10): (2.0, 1), (1, 11): (7.0, 1)}][k]


def test_streamed_vwap_and_distinct_rows(spark, tmp_path):
    rows = [(1, at(1, 1), 10.0, 1, "x"), (1, at(1, 2), 20.0, 3, "x"), (1, at(5), 1.0, 0, "y"), (1, at(9), 1.0, 1, "x")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "symbol_id long, time timestamp, price double, size long, kind string").write.parquet(source)
    stream = spark.readStream.schema("symbol_id long, time timestamp, price double, size long, kind string").parquet(source)
    for name, frame, want in (("vwap", streams.stream_vwap(stream).select(F.dayofmonth("bucket"), "vwap", "total_volume"), [(1, 17.5, 4), (5, None, 0)]), ("kinds", streams.stream_distinct(stream, ["kind"]).select("kind"), [("x",), ("y",)])):
        frame.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(spark.read.parquet(str(tmp_path / name))) == want
