import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tidemark.llm import mixing, queries


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_matches_its_sql(spark, sf):
    assert differences(queries.op7_mixing(spark, sf), connect(sf), queries.oracle_sql()["op7_mixing"]) == ""


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "top string, low string, have long")
    got = mixing.leaf_targets(leaves, ["top", "low"], {}, share=0.5, epochs=1).collect()
    assert {(r["top"], r["low"]): r["target"] for r in got} == {("a", "x"): 10.0, ("a", "y"): 492.5, ("b", "x"): 502.5}


def test_an_ancestor_takes_what_siblings_cannot(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 1000)], "top string, low string, have long")
    got = mixing.leaf_targets(leaves, ["top", "low"], {"top": {"b": 0}}, share=0.5, epochs=1).collect()
    assert {(r["top"], r["low"]): r["target"] for r in got} == {("a", "x"): 10.0, ("a", "y"): 20.0}


def test_whole_epochs_and_a_prefix(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 3), "s") for k in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(docs, ["source"], {}, share=1.5, epochs=2)
    sums = {r["epoch"]: r["n"] for r in got.groupBy("epoch").agg(F.sum("tokens").alias("n")).collect()}
    assert sums[0] == 600 and 297 <= sums[1] <= 300


def test_edges(edge, nothing):
    found = mixing.mix(edge.withColumnRenamed("shard", "epoch"), ["lang", "source"], {}, share=2.0, epochs=2)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "epoch"]
    assert found.count() == 2 * edge.count()
    light = mixing.mix(edge.drop("shard"), ["lang", "source"], {}, share=1.1, epochs=2, with_text=False)
    whole = mixing.mix(edge.drop("shard"), ["lang", "source"], {}, share=1.1, epochs=2).drop("text")
    assert light.columns == whole.columns and sorted(map(str, light.collect())) == sorted(map(str, whole.collect()))
    assert mixing.mix(nothing, ["lang", "source"], {}, share=0.8).count() == 0
