"""Digests of a group's contents, whatever the order of its rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Row digests packed into one piece, 32 letters each.
PIECE = 32_768


def content_digest(rows: DataFrame, key: str, value: Column, name: str = "hash") -> DataFrame:
    """MD5 of the sorted MD5s of ``value`` for each ``key``; null values count for nothing.

    Rows are range-partitioned and sorted by key and hash, so a large group is
    sorted by many tasks; each packs its run of hashes into pieces. The pieces
    of a key, a few bytes a row, then stream in order through one digest,
    which is all that is held of a group.
    """
    hashed = rows.select(F.col(key), F.md5(value.cast("binary")).alias("_h"))
    kind = hashed.schema[key]
    packed = T.StructType([kind, T.StructField("place", T.LongType()), T.StructField("piece", T.StringType())])
    digests = T.StructType([kind, T.StructField(name, T.StringType())])
    arrow, last = to_arrow_schema(packed), to_arrow_schema(digests)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, place = None, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            out = []
            for group, h in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or group != own or len(held) >= PIECE:
                    if held is not None:
                        out.append((own, place, "".join(held)))
                        place += 1
                    own, held = group, []
                if h is not None:
                    held.append(h)
            yield _batch(out, arrow)
        if held is not None:
            yield _batch([(own, place, "".join(held))], arrow)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest = None, None
        for batch in batches:
            out = []
            for group, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or group != own:
                    if digest is not None:
                        out.append((own, digest.hexdigest()))
                    own, digest = group, hashlib.md5(usedforsecurity=False)
                digest.update(piece.encode())
            yield _batch(out, last)
        if digest is not None:
            yield _batch([(own, digest.hexdigest())], last)

    # Equal hashes are interchangeable; a number of their own lets them lie in several partitions.
    ranged = hashed.withColumn("_no", F.monotonically_increasing_id()).repartitionByRange(key, "_h", "_no").sortWithinPartitions(key, "_h")
    pieces = ranged.select(key, "_h").mapInArrow(pack, packed)
    return pieces.repartition(key).sortWithinPartitions(key, "place").mapInArrow(joined, digests)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def changed(now: DataFrame, stored: DataFrame, key: str, name: str = "hash") -> DataFrame:
    """Keys whose digest differs from the stored one, with ``change``: ``new``, ``gone`` or ``changed``."""
    old = stored.select(F.col(key), F.col(name).alias("_old"))
    both = now.select(F.col(key), F.col(name).alias("_new")).join(old, key, "full_outer")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")
