import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import queries, winnow


def plain(text):
    points = [ord(c) for c in text]
    n = len(points) - winnow.GRAM + 1
    if n < 1:
        return None
    hashed = winnow._hashes(np.array(points, dtype=np.uint64)) & ~winnow._LOW
    chosen = set()
    for start in range(max(1, n - winnow.WINDOW + 1)):
        window = range(start, min(n, start + winnow.WINDOW))
        chosen.add(min(window, key=lambda k: (hashed[k], -k)))
    return [(int(hashed[k]), k) for k in sorted(chosen)]


@pytest.mark.parametrize("size", [8, 9, 22, 23, 24, 40, 500])
def test_rightmost_least_of_each_window(size, monkeypatch):
    rng = random.Random(size)
    text = "".join(rng.choices("ab", k=size))
    for length in (winnow.PASS, 37):
        monkeypatch.setattr(winnow, "PASS", length)
        hashes, places = winnow.winnow(text)
        assert list(zip(hashes.tolist(), places.tolist())) == plain(text)


def test_a_shared_passage_is_found():
    rng = random.Random(0)
    shared = "".join(rng.choices("abcdefgh", k=winnow.GRAM + winnow.WINDOW - 1))
    one, two = ("".join(rng.choices("xyz", k=90)) + shared + "".join(rng.choices("uvw", k=70)) for _ in range(2))
    assert set(winnow.winnow(one)[0].tolist()) & set(winnow.winnow(two)[0].tolist())


def test_edits_follow_the_order_of_ids(spark, sf):
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op4_winnowing(spark, sf).collect()}
    assert len(got) == len(texts)
    names = {}
    for k, (doc, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        row = got[doc]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = ({*winnow.winnow(t)[0].tolist()} for t in (text, edited, following))
        for name, other in (("near_edited", b), ("near_next", c)):
            assert row[name] == pytest.approx(2 * len(a & other) / (len(a) + len(other)) if a or other else 1.0)
        assert names.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    assert len(set(names.values())) == len(names)


def test_order_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 5)
    docs = spark.createDataFrame([(k * 3, f"text number {k}") for k in range(57)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["edited_sha256"] for r in winnow.edit_likeness(docs).collect()}
    for k in range(57):
        own, following = f"text number {k}", f"text number {(k + 1) % 57}"
        assert got[k * 3] == hashlib.sha256((own[: len(own) - len(own) // 4] + following[: len(own) // 4]).encode()).hexdigest()


def test_edges(edge, nothing):
    assert winnow.edit_likeness(edge).count() == edge.count()
    assert winnow.edit_likeness(nothing).count() == 0
    rows = winnow.fingerprints(edge).collect()
    assert len(rows) == edge.count() and all(r["fingerprint"] == [] for r in rows if not r["text"])
