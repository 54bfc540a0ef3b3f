import numpy as np

from tidemark.llm import neighbours, queries


def exact(rows, results):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    found = {}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            near = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:results]
            found[int(i)] = [(int(ids[j]), float(s[j])) for j in near]
    return found


def check(got, want, least):
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by_query.keys() == want.keys()
    hits = [len({v for v, _ in by_query[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want]
    assert np.mean(hits) >= least
    for near in by_query.values():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op5_neighbours(spark, sf).collect(), exact([r for r in rows if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])], 20), 0.9)


def test_recall_of_descent_and_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 24))) * rng.uniform(0.8, 1.2, (3000, 1))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(neighbours.nearest(table, lambda i: i % 20 == 0).collect(), exact(rows, 20), 0.9)


def test_edges(spark):
    bad = [(20, None), (21, []), (22, [0.0, 0.0]), (23, [None, 1.0]), (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (26, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e190, 1e200]), (2, [2e199, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in neighbours.nearest(huge, lambda i: i % 20 == 0).orderBy("rank").collect()] == [1, 2]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0]), (40, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in bad + good], "vec_id long, embedding array<double>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(table, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 40, 1.0), (0, 3, 2, 0.5), (40, 1, 0, 1.0), (40, 2, 1, 1.0), (40, 3, 2, 0.5)]
    assert neighbours.nearest(table.where("1 = 0"), lambda i: i % 20 == 0).count() == 0
