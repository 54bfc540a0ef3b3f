from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.shards import CELLS, capacities, place, ring, shard_by_ring


def test_counts_differ_by_one_and_slots_are_gapless(spark, sf):
    rows = queries.op1_shard_ring(spark, sf).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_overflow_goes_clockwise():
    owned = [0, 0, 1, 1]
    assert place({0: 3, 2: 1}, owned, [2, 2]) == [(0, 0, 2, 0, 0), (2, 0, 1, 1, 0), (0, 2, 3, 1, 1)]


def test_one_more_shard_moves_few_keys():
    before, after = ring(16, 64), ring(17, 64)
    moved = [(a, b) for a, b in zip(before, after) if a != b]
    assert {b for _, b in moved} == {16} and len(moved) < 0.15 * len(before)


def test_slack_bounds_loads(spark):
    keys = spark.range(1000).withColumnRenamed("id", "doc_id")
    load = Counter(r["shard"] for r in shard_by_ring(keys, F.col("doc_id"), shards=8, slack=0.25).collect())
    assert max(load.values()) <= capacities(1000, 8, 0.25)[0] == 157


def walked(keys, owned, capacity):
    """The shard and slot of each key (in the order of its cell): keys offer themselves cell by cell, and what a full shard refuses goes on clockwise in the next wave."""
    room, filled, found = list(capacity), [0] * len(capacity), {}
    waiting = [(cell, k, cell) for k, cell in keys]
    while waiting:
        refused = []
        for cell, k, at in sorted(waiting, key=lambda x: x[0]):
            shard = owned[at]
            if room[shard]:
                room[shard] -= 1
                found[k] = (shard, filled[shard])
                filled[shard] += 1
            else:
                refused.append((cell, k, at))
        waiting = []
        for cell, k, at in refused:
            while not room[owned[at]]:
                at = (at + 1) % len(owned)
            waiting.append((cell, k, at))
    return found


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_placement_matches_a_walk_of_every_key(spark, slack):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    at = F.xxhash64(F.lit("ring"), "doc_id")
    cells = [(r["doc_id"], r["cell"]) for r in keys.select("doc_id", at.alias("at"), F.pmod(at, F.lit(CELLS)).cast("int").alias("cell")).orderBy("cell", "at").collect()]
    want = walked(cells, ring(8, 64), capacities(3000, 8, slack))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_by_ring(keys, F.col("doc_id"), shards=8, slack=slack).collect()} == want


def test_one_more_shard_moves_few_rows(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    before, after = ({r["doc_id"]: r["shard"] for r in shard_by_ring(keys, F.col("doc_id"), shards=n, slack=0.5).collect()} for n in (16, 17))
    moved = [k for k in before if before[k] != after[k]]
    assert len(moved) < 0.2 * len(before) and sum(after[k] == 16 for k in moved) > 0.4 * len(moved)


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(1000).selectExpr("cast(null as long) as doc_id", "id as size", "id * 7 as crc")
    found = shard_by_ring(rows, F.col("doc_id"), shards=4, tie=[F.col("size"), F.col("crc")])
    assert found.count() == 1000 and {r["n"] for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {250}


def test_edges(edge, nothing):
    df = edge.withColumnRenamed("lang", "slot")
    assert shard_by_ring(df, F.col("doc_id"), shards=4).columns.count("shard") == 1
    df = edge.drop("shard")
    assert shard_by_ring(df, F.col("doc_id"), shards=4).count() == edge.count()
    assert shard_by_ring(nothing.drop("shard"), F.col("doc_id")).count() == 0
