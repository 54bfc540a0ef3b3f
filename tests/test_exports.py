import glob

import pyarrow.parquet as pq

from tidemark.operators import ingest


def test_a_large_month_is_written_by_many_tasks(spark, tmp_path):
    """One month with most rows, one symbol with half of them: runs of the order, none with most rows, and no row lost."""
    n = 40_000
    rows = spark.range(n).selectExpr("if(id % 2 = 0, 0, id % 50) as symbol_id", f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(if(id % 10 = 0, 40, 0), 0, 0, id * 7919 % {n}) as time", "id * 0.5D as price")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ingest.export_months(rows, str(tmp_path / "months"), order=["symbol_id", "time"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "months"))
    assert back.select("symbol_id", "time", "price").exceptAll(rows).isEmpty() and back.count() == n
    assert back.where("year <> year(time) or month <> month(time)").isEmpty()
    runs = []
    for path in glob.glob(str(tmp_path / "months/year=2024/month=1/*.parquet")):
        held = pq.read_table(path, partitioning=None).select(["symbol_id", "time"]).to_pydict()
        keys = list(zip(held["symbol_id"], held["time"]))
        assert keys == sorted(keys)
        runs.append((keys[0], keys[-1], len(keys)))
    runs.sort()
    assert len(runs) > 1 and max(size for _, _, size in runs) < 0.6 * n
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))
