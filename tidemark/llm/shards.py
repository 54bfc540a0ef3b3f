"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` positions. Each shard owns ``vnodes`` of them, drawn by
hash; a key belongs to the first virtual node at or after the cell that its
hash falls in. A shard takes at most its capacity; keys that overflow a full
shard continue clockwise to the next one with room. Without slack the
capacities sum to the number of rows, so all shards fill exactly and their
counts differ by one at most; with slack fewer keys move.

Spark does the work on rows: a count for each cell, and a rank inside each
cell. Only the counts, one number a cell whatever the input, reach the driver,
which turns them into a table of (cell, ranks from, ranks to, shard, first
slot) that is joined back by broadcast; its size is bounded by ``cells`` plus
``shards`` squared.

Defined results: rows without a key take the ring position of their tie
columns, so that they are spread; rows with equal keys are told apart by these
and, if they are equal too, are interchangeable; an empty table gives no rows.
Other columns are not read; ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 14


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the first virtual node clockwise."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for node in range(vnodes):
            for attempt in count():
                digest = hashlib.sha256(f"{shard}/{node}/{attempt}".encode()).digest()
                cell = int.from_bytes(digest[:8], "big") % cells
                if cell not in owner:
                    owner[cell] = shard
                    break
    owned, following = [0] * cells, owner[min(owner)]
    for cell in range(cells - 1, -1, -1):
        following = owner.get(cell, following)
        owned[cell] = following
    return owned


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Bounds on each shard's load; without slack they add up to ``rows``."""
    if slack <= 0:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def place(counts: dict[int, int], owned: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs of ranks in each cell with their shard and the slot of the first.

    In every wave each cell offers its keys to the shard it has come to;
    shards admit in ring order, and what they refuse goes on clockwise.
    """
    cells = len(owned)
    room, filled = list(capacity), [0] * len(capacity)
    waiting = {cell: (0, n, cell) for cell, n in counts.items() if n}
    runs = []
    while waiting:
        refused = {}
        for cell in sorted(waiting):
            start, n, at = waiting[cell]
            shard = owned[at]
            taken = min(n, room[shard])
            if taken:
                runs.append((cell, start, start + taken, shard, filled[shard]))
                room[shard] -= taken
                filled[shard] += taken
            if taken < n:
                refused[cell] = (start + taken, n - taken, at)
        for cell, (start, n, at) in refused.items():
            while room[owned[at]] == 0:
                at = (at + 1) % cells
            refused[cell] = (start, n, at)
        waiting = refused
    return runs


def shard_by_ring(df: DataFrame, key: Column, *, shards: int = 16, vnodes: int = 64, slack: float = 0.0, tie: list[Column] | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to every row of ``df``.

    ``key`` decides the ring position; ``tie`` orders rows of equal position.
    """
    spark = df.sparkSession
    hashed = F.when(key.isNull(), F.xxhash64(F.lit("ring"), *(tie or []))).otherwise(F.xxhash64(F.lit("ring"), key))
    placed = df.drop("shard", "slot").withColumn("_at", hashed).withColumn("_cell", F.pmod(F.col("_at"), F.lit(CELLS)).cast("int"))
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    owned = ring(shards, vnodes)
    runs = place(counts, owned, capacities(sum(counts.values()), shards, slack))
    table = spark.createDataFrame(runs, "_cell int, _from long, _to long, shard int, _first long")
    order = Window.partitionBy("_cell").orderBy("_at", key, *(tie or []))
    ranked = placed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    held = (ranked["_cell"] == table["_cell"]) & (ranked["_rank"] >= table["_from"]) & (ranked["_rank"] < table["_to"])
    joined = ranked.join(F.broadcast(table), held).drop(table["_cell"])
    return joined.withColumn("slot", F.col("_first") + F.col("_rank") - F.col("_from")).drop("_at", "_cell", "_rank", "_from", "_to", "_first")
