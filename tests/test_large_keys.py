import datetime

import pytest

from tests.compare import connect, differences
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", ["section_carry_forward", "extract_date", "table_changes"])
def test_order_keys_of_more_than_five_digits(spark, tmp_path, name):
    """Keys around powers of ten, where leading and last digits part."""
    keys = [k + d for k in (0, 99_990, 100_000, 999_990, 1_234_567, 9_999_999_990) for d in range(10)]
    rows = [(k, k // 10, "O", 1.0, datetime.datetime(1995, 1, 1) + datetime.timedelta(days=n), "1-URGENT") for n, k in enumerate(keys)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    orders.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    assert differences(catalogue.FOUND[name](spark, str(tmp_path)), connect(str(tmp_path)), catalogue.SQL[name]) == ""
