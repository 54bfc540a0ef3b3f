import datetime

from tidemark.operators import universe

D = [datetime.date(2000, 1, k) for k in range(1, 11)]


def test_daily_counts_of_all_days(spark):
    """Days without events, open and empty memberships, and days before the first one."""
    rows = [("a", 1, D[1], D[4]), ("a", 2, D[3], None), ("b", 1, D[2], D[5]), ("b", 2, D[7], D[7]), ("a", 3, None, D[6])]
    members = spark.createDataFrame(rows, "index_code string, symbol_id long, entry_date date, exit_date date")
    days = [D[k] for k in (0, 2, 3, 4, 5, 8, 8)]
    want = {(d, i): n for d in days for i in "ab" if (n := sum(c == i and e is not None and e <= d and (x is None or x > d) for c, _, e, x in rows))}
    found = universe.daily_counts(members, spark.createDataFrame([(d,) for d in days], "day date")).collect()
    assert len(found) == len(want) and {(r["day"], r["index_code"]): r["members"] for r in found} == want
