"""Tables written to the folder that the cluster shares, where a result is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files at ``path``; an existing folder without any gives no rows, a missing one is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def inventory(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Number and bytes of the files below each folder of ``path``, from their names and sizes alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def csv_members(spark: SparkSession, path: str, *, sector: str | None = None) -> DataFrame:
    """``ticker, name, sector`` of a membership list with a header; a byte-order mark goes, names are trimmed and tickers upper-cased, rows without a ticker are dropped."""
    raw = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    named = raw.select(*[F.btrim(F.col(f"`{c}`")).alias(c.strip("\ufeff \"").lower()) for c in raw.columns])
    rows = named.select(F.upper("ticker").alias("ticker"), "name", "sector").where("ticker <> ''")
    return rows if sector is None else rows.where(F.col("sector") == sector)
