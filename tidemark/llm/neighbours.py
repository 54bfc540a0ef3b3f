"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node. To make the largest inner product a nearest
neighbour, a component is added that gives all nodes the same norm; a query
has zero there. The graph starts from random-projection trees: nodes sorted by
the signs of some projections are cut into small leaves, and each node links to
its best in its leaf. Then rounds of NN-descent: every node gathers its
neighbours and a sample of those it is a neighbour of, compares them with each
other, and tells each of better ones; joins bring the vectors. They end when a
round changes less than ``STILL`` of the links. A query starts at its own node;
rounds of joins expand the best nodes it hasn't expanded, along links and
against them, until none of the best is left; how many it keeps grows with the
logarithm of the number of nodes (``beam``). Graph and search use half-precision vectors; the result
is ranked again in double precision on the original ones.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do those of another length than most;
a row repeated with its id counts once; with fewer candidates than asked for,
all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Bucketed, Kept, Working, keep

DEGREE, REVERSE, TELL = 32, 16, 6
TREES, LEAF, LEAF_LINKS, LEAF_ROWS = 8, 256, 16, 16_384
#: The share of links that may still change when descent ends.
STILL = 0.03
#: Best nodes a search keeps among up to SIZE nodes; half as many more for each doubling beyond. Nodes expanded in a round, and those followed against a link's direction.
BEAM, SIZE, EXPAND, BACK = 256, 10_000, 64, 64
#: Nodes for each bucket of the table that searches join with.
BUCKET_NODES = 2048
SEED = 11


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the vectors that take part."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    whole = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return whole.where(F.size("v") == (most["d"] if most else 0))


def classes(rows: DataFrame, results: int) -> DataFrame:
    """Distinct vectors: ``node`` (least id), ``v``, and the least ``results + 1`` ids, which are all that can be asked for."""
    keyed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v"))).dropDuplicates(["id", "h1", "h2"])
    least = keyed.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("k") <= results + 1)
    return least.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(values, dtype=np.float64).reshape(len(column), -1)


def _halves(nodes: DataFrame, largest: float, norm: float) -> DataFrame:
    """``node`` and its vector, divided by ``largest`` and made of norm ``norm``, as half-precision bytes."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) / largest / norm
            x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))]).astype("<f2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "vec"])

    return nodes.select("node", "v").mapInArrow(told, "node long, vec binary")


def _vectors(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f2").reshape(len(blobs), -1).astype(np.float32)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["a", "b", "s"])


EDGES = "a long, b long, s float"


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The best distinct links of each node; Spark prunes each task's rows before the shuffle."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("k") <= degree).drop("k")


def _in_leaves(nodes: DataFrame, count: int) -> DataFrame:
    bits = (count // LEAF).bit_length()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1).to_pylist()) if batch.num_rows else np.empty((0, 1), np.float32)
            for tree in range(TREES):
                rng = np.random.default_rng([SEED, tree])
                planes = rng.standard_normal((x.shape[1], bits + 1)).astype(np.float32)
                at = x @ planes
                code = (at[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array(code.astype(np.int64)), pa.array(at[:, bits]), *batch.columns], names=["tree", "code", "at", "node", "vec"])

    def leaf(ids: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        x, names = _vectors(blobs), np.array(ids)
        scores = x @ x.T
        np.fill_diagonal(scores, -np.inf)
        k = min(LEAF_LINKS, len(ids) - 1)
        if not k:
            return _edges([], [], [])
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        return _edges(np.repeat(names, k), names[top].ravel(), np.take_along_axis(scores, top, axis=1).ravel())

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs, now = [], [], None
        for batch in batches:
            for tree, node, vec in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if ids and (tree != now or len(ids) >= LEAF):
                    yield leaf(ids, blobs)
                    ids, blobs = [], []
                now = tree
                ids.append(node)
                blobs.append(vec)
        if ids:
            yield leaf(ids, blobs)

    dealt = nodes.mapInArrow(coded, "tree int, code long, at float, node long, vec binary")
    wide = dealt.repartitionByRange(max(1, count * TREES // LEAF_ROWS), "tree", "code", "at", "node").sortWithinPartitions("tree", "code", "at", "node")
    return wide.mapInArrow(linked, EDGES)


def beam(count: int) -> int:
    """Best nodes that a search among ``count`` nodes keeps."""
    return round(BEAM * (1 + max(0.0, math.log2(max(count, 1) / SIZE)) / 2))


def _around(edges: DataFrame, most: int = REVERSE) -> DataFrame:
    """Each node ``a`` with its links and a sample of those that link to it."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sampled = back.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b", "a"), "b"))).where(F.col("k") <= most).drop("k")
    return edges.select("a", "b").unionByName(sampled).distinct()


def _descent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that neighbours of a common node tell each other of."""
    worst = edges.groupBy("a").agg(F.min("s").alias("worst"), F.count("*").alias("n")).select(F.col("a").alias("b"), F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(-2.0).cast("float").alias("worst"))
    told = nodes.select(F.col("node").alias("b"), "vec").join(worst, "b")
    lists = _around(edges).join(told, "b").groupBy("a").agg(F.collect_list(F.struct("b", "vec", "worst")).alias("near"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for near in batch.column(0).to_pylist():
                if len(near) < 2:
                    continue
                names = np.array([x["b"] for x in near])
                x = _vectors([x["vec"] for x in near])
                scores = x @ x.T
                np.fill_diagonal(scores, -np.inf)
                k = min(TELL, len(near) - 1)
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(scores, top, axis=1)
                rows, cols = np.nonzero(best > np.array([x["worst"] for x in near], dtype=np.float32)[:, None])
                out.append((names[rows], names[top[rows, cols]], best[rows, cols]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return lists.select("near").mapInArrow(compared, EDGES)


def neighbour_graph(nodes: DataFrame, count: int) -> DataFrame:
    """The ``DEGREE`` best links (a, b, s) found of each node."""
    now = Kept(_best(_in_leaves(nodes, count), DEGREE), "graph")
    links = now.df.count()
    while links:
        then = Kept(_best(now.df.unionByName(_descent(now.df, nodes)), DEGREE), "graph")
        fresh, links = then.df.join(now.df, ["a", "b"], "left_anti").count(), then.df.count()
        now.drop()
        now = then
        if fresh < STILL * links:
            break
    return now.df


POOL = "q long, vec binary, pool array<long>, scores array<float>, done array<boolean>"


def _adjacency(edges: DataFrame, nodes: DataFrame, count: int) -> Bucketed:
    """Each node with its neighbours' ids and vectors, bucketed by node so that searches don't shuffle it."""
    lists = _around(edges, BACK).join(nodes.select(F.col("node").alias("b"), "vec"), "b").groupBy("a").agg(F.collect_list(F.struct("b", "vec")).alias("near"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for near in batch.column(1).to_pylist():
                ids.append([x["b"] for x in near])
                blobs.append(b"".join(x["vec"] for x in near))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["a", "ids", "vecs"])

    buckets = max(1, count // BUCKET_NODES)
    return Bucketed(lists.mapInArrow(joined, "a long, ids array<long>, vecs binary").repartition(buckets, "a"), "a", "around", buckets)


def _search_round(state: DataFrame, around: DataFrame, most: int) -> DataFrame:
    open_ = F.slice(F.filter(F.arrays_zip("pool", "done"), lambda x: ~x["done"]), 1, EXPAND)
    worst = F.when(F.size("pool") >= most, F.array_min("scores")).otherwise(F.lit(-9.0)).cast("float")
    front = state.select("q", "vec", worst.alias("worst"), F.explode(F.transform(open_, lambda x: x["pool"])).alias("a"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs, found, scores = [], [], []
            for q, vec, worst, ids, vecs in zip(*(batch.column(k) for k in range(5))):
                names = ids.values.to_numpy(zero_copy_only=False)
                x = np.frombuffer(vecs.as_py(), dtype="<f2").reshape(len(names), -1).astype(np.float32)
                s = x @ _vectors([vec.as_py()])[0]
                good = np.flatnonzero(s > worst.as_py())
                if len(good):
                    qs.append(q.as_py())
                    found.append(names[good])
                    scores.append(s[good])
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32()))], names=["q", "ids", "s"])

    met = front.join(around, "a").select("q", "vec", "worst", "ids", "vecs").mapInArrow(scored, "q long, ids array<long>, s array<float>")
    lists = met.groupBy("q").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("s")).alias("s"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                done, left = {}, EXPAND
                for node, d in zip(row["pool"], row["done"]):
                    left -= not d
                    done[node] = d or left >= 0
                scores = dict(zip(row["ids"] or [], row["s"] or [])) | dict(zip(row["pool"], row["scores"]))
                pool = sorted(scores, key=lambda node: (-scores[node], node))[:most]
                out.append({"q": row["q"], "vec": row["vec"], "pool": pool, "scores": [scores[n] for n in pool], "done": [done.get(n, False) for n in pool]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("q", pa.int64()), ("vec", pa.binary()), ("pool", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_()))]))

    return state.join(lists, "q", "left").mapInArrow(merged, POOL)


def graph_search(queries: DataFrame, edges: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """``q`` and the ``pool`` of its best nodes; ``queries`` has node ``q`` and query vector ``vec``."""
    around = _adjacency(edges, nodes, count)
    start = queries.select("q", "vec", F.array("q").alias("pool"), F.array(F.lit(9.0).cast("float")).alias("scores"), F.array(F.lit(False)).alias("done"))
    now = Kept(start, "search")
    while not now.df.where(F.exists("done", lambda d: ~d)).isEmpty():
        then = Kept(_search_round(now.df, around.df, beam(count)), "search")
        now.drop()
        now = then
    around.drop()
    return now.df.select("q", F.explode("pool").alias("node"))


def nearest(df: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", results: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found of each row for which ``is_query(id)`` holds."""
    with Working() as work:
        rows = keep(usable(df, vec_id, vector), "vectors")
        groups = work.spare(Kept(classes(rows, results), "nodes"))
        # Components are taken relative to the largest one, so that no square overflows.
        largest = groups.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest))
        count, norm = groups.agg(F.count("*"), F.max(F.sqrt(square))).first()
        nodes = keep(_halves(groups, largest, norm or 1.0), "halves")
        edges = neighbour_graph(nodes, count)
        asked = work.spare(Kept(rows.where(is_query(F.col("id"))).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")).distinct().join(groups.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"), "asked"))

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch.column(1).to_pylist())
                    x[:, -1] = 0
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())], names=["q", "vec"])

        wanted = asked.select("node").distinct()
        seekers = nodes.join(wanted, "node").mapInArrow(plain, "q long, vec binary")
        found = work.spare(Kept(graph_search(seekers, edges, nodes, count), "found"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(groups.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").join(groups.select("node", "v", "ids"), "node").select("q", "ids", dot.alias("score"))
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= results + 1)
    lists = first.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, asked["node"] == lists["q"]).select("id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, results).alias("near"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
