"""Tables that cut lineage, kept in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder; a folder of our own is set only
where the session has none and runs on one machine (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set to a fresh one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = spark.sparkContext.getCheckpointDir()
        named = held
    return named.rstrip("/")


_SCOPES: list[list[Kept]] = []


class Working:
    """Tables written inside go at its end, but for those spared because the result reads them."""

    def __enter__(self) -> Working:
        _SCOPES.append([])
        self.spared: list[Kept] = []
        return self

    def spare(self, kept: Kept) -> DataFrame:
        self.spared.append(kept)
        return kept.df

    def __exit__(self, *_) -> None:
        for kept in _SCOPES.pop():
            if kept not in self.spared:
                kept.drop()
        if _SCOPES:
            _SCOPES[-1].extend(self.spared)


class Kept:
    """A written table: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        # The written table stands in for the shuffles that led to it; they needn't wait for the driver's garbage collection.
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            self.df = self._written(df)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def _written(self, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path)
        return self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Bucketed(Kept):
    """A written table bucketed by ``key``: grouping and joining by it doesn't shuffle it again."""

    def __init__(self, df: DataFrame, key: str, name: str, buckets: int | None = None, codec: str = "snappy"):
        self.codec = codec
        self.key, self.buckets = key, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        super().__init__(df, name)

    def _written(self, df: DataFrame) -> DataFrame:
        df.write.bucketBy(self.buckets, self.key).option("path", self.path).option("compression", self.codec).saveAsTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return Kept(df, name).df
