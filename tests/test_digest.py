import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import digest, metrics
from tidemark.sources import market


def plain(rows):
    out = {}
    for key, value in rows:
        out.setdefault(key, [])
        if value is not None:
            out[key].append(hashlib.md5(value.encode()).hexdigest())
    return {k: hashlib.md5("".join(sorted(v)).encode()).hexdigest() for k, v in out.items()}


@pytest.mark.parametrize("piece", [1, 7, digest.PIECE])
def test_digests_of_groups_over_many_tasks(spark, monkeypatch, piece):
    """One group holds most rows, many of them equal; nulls in key and value, an empty value, one group of nulls only."""
    monkeypatch.setattr(digest, "PIECE", piece)
    rows = [("big", f"v{k % 50}") for k in range(3000)] + [(None, "x"), (None, None), ("none", None), ("empty", ""), ("é", "É")]
    frame = spark.createDataFrame(rows, "k string, v string")
    for parts in (1, 5):
        found = {r["k"]: r["hash"] for r in digest.content_digest(frame.repartition(parts), "k", F.col("v")).collect()}
        assert found == plain(rows)
    assert digest.content_digest(frame.where("1 = 0"), "k", F.col("v")).isEmpty()


def test_changes_of_digests(spark):
    now, old = (spark.createDataFrame(rows, "k string, hash string") for rows in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert sorted(tuple(r) for r in digest.changed(now, old, "k").collect()) == [("b", "changed"), ("c", "new"), ("d", "gone")]


def test_histogram_of_equal_bins(spark):
    rng = np.random.default_rng(3)
    values = {"a": [*rng.normal(size=500).tolist(), None, float("nan")], "flat": [2.0] * 9, "two": [0.0, 1.0], "none": [None]}
    frame = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, v double")
    got = {}
    for r in metrics.histogram(frame, "k", "v", 80).collect():
        got.setdefault(r["k"], {})[r["bin"]] = (r["low"], r["n"])
    assert got.keys() == {"a", "flat", "two"}
    for k, own in got.items():
        counts, edges = np.histogram([v for v in values[k] if v is not None and v == v], bins=80)
        assert [own[b][1] for b in range(80)] == counts.tolist() and np.allclose([own[b][0] for b in range(80)], edges[:-1])


def test_names_are_checked_before_anything_is_read(spark):
    with pytest.raises(ValueError, match="unknown table"):
        market.table(spark, "/nowhere", "ohlcv; drop")
    codes = spark.createDataFrame([(2104,), (200,), (None,)], "code int")
    assert sorted(r["code"] or 0 for r in market.notable(codes).collect()) == [0, 200]
