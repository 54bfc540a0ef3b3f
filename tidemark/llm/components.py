"""Connected components in Spark: alternating large-star and small-star steps.

Each step is an aggregation to a minimum, combined before the shuffle, and a
join of links with those minima. A hub's links are spread over salts in the
join, so no task holds all of them. Every round is written to the shared
folder; earlier rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Kept

SALTS = 16


def _least(links: DataFrame) -> DataFrame:
    """Links with the least neighbour (or itself) of their first node."""
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    spread = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    # Most nodes have a link or two: the minimum goes only to salts that occur.
    found = spread.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"))
    least = found.select("u", F.least("m", "u").alias("m"), "salts", salts.alias("salt")).where("shiftright(salts, salt) & 1 = 1").drop("salts")
    return spread.join(least, ["u", "salt"]).drop("salt")


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has long columns ``u`` and ``v``; returns each linked node with its least reachable ``root``."""
    first = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = Kept(first, "links")
    sign = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        then = Kept(stars.where("u <> v").distinct(), "links")
        now.drop()
        now = then
        last, sign = sign, now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last:
            break
    roots = now.df.select(F.col("v").alias("node")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
