"""A table in the shared folder whose writes rewrite only the partitions they touch.

Each write has a number and puts whole partitions below it; of a partition the
last finished write counts, so readers see a state before or after a write and
a write that was cut short leaves nothing to see. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Stored:
    """``part`` is a column of few values, like a day or a month, that is never null."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, part: str):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _names(self, path: str, wanted: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(m[1] for f in (store.listStatus(at) if store.exists(at) else []) if (m := re.fullmatch(wanted, f.getPath().getName())))

    def writes(self) -> list[str]:
        """Numbers of the finished writes."""
        return [n for n in self._names(self.path, r"write=(\d+)") if self._names(f"{self.path}/write={n}", "(_SUCCESS)")]

    def current(self) -> dict[str, str]:
        """By partition the folder that holds it now."""
        found = {}
        for n in self.writes():
            found |= {p: f"{self.path}/write={n}/_part={p}" for p in self._names(f"{self.path}/write={n}", "_part=(.*)")}
        return found

    def read(self, parts: list | None = None) -> DataFrame:
        """The table, or its partitions of these values."""
        wanted = None if parts is None else {str(p) for p in parts}
        folders = [f for p, f in self.current().items() if wanted is None or p in wanted]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        """Replaces the partitions that ``rows`` have rows of."""
        number = 1 + max((int(n) for n in self._names(self.path, r"write=(\d+)")), default=0)
        named = rows.select(*self.schema.names).withColumn("_part", F.col(self.part).cast("string"))
        named.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/write={number:08d}")


def values(rows: DataFrame, column: str) -> list:
    """The few values of a partition column."""
    return [r[0] for r in rows.select(column).distinct().collect()]
