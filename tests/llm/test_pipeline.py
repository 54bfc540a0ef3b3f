from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_duplicates import plain_fingerprint, roots
from tidemark.llm import langid

NAMED = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mixed", "packed"]


def test_language_rejects_by_its_model(spark, docs, sf):
    langs, logs, priors = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    rows = docs.select("doc_id", "text").collect()
    names, _, fits = langid.score_texts([r["text"] for r in rows], langs, logs.T, priors)
    want = {r["doc_id"] for r, n, f in zip(rows, names, fits) if n != "und" and f > 0}
    found = NAMED["language"](spark, docs, sf)
    assert found.columns == docs.columns and {r["doc_id"] for r in found.select("doc_id").collect()} == want
    assert len(want) > 0.8 * len(rows)


def test_near_copies_keep_one_of_each_group(spark, docs, sf):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    root = roots(sorted(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    found = NAMED["near_copies"](spark, docs, sf)
    assert found.columns == docs.columns and sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(set(root.values()))


def test_all_stages(spark, docs, sf):
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).toPandas(), docs.schema) if name == "mixed" else stage(spark, now, sf)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert 0 < sizes[2] <= sizes[1] <= sizes[0]
    out = corpus_pipeline.run(spark, sf).collect()
    assert len({r["sequence_id"] for r in out}) <= len(out)
    assert sum(r["piece"] == 0 for r in out) == sizes[3]


def test_edges(spark, edge, nothing, sf):
    """Nulls, blank and long texts, repeats and rows without an id, through each stage by itself."""
    rows = Counter((r["doc_id"], r["text"]) for r in edge.collect())
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stage(spark, edge, sf).collect()
        assert stage(spark, nothing, sf).count() == 0, name
    kept = Counter((r["doc_id"], r["text"]) for r in found["language"])
    assert kept and not kept - rows and all(r["lang"] for r in found["language"])
    assert all(any(c.isalpha() for c in text or "") for _, text in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in found["lines"])
    # One document of each group stays; texts of equal fingerprint are one group whatever their ids.
    prints = {text: plain_fingerprint(text) for _, text in rows}
    groups = roots(range(len(texts := list(prints))), [(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    left = [groups[texts.index(r["text"])] for r in found["near_copies"]]
    assert sorted(left) == sorted(set(groups.values()))
    mixed = Counter((r["doc_id"], r["text"]) for r in found["mixed"])
    assert mixed and all(n <= corpus_pipeline.EPOCHS * rows[k] for k, n in mixed.items())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(n * (1 + len(library.encode(text or "", add_special_tokens=False).ids)) for (_, text), n in rows.items())
    assert sum(r["length"] for r in found["packed"]) == tokens and sum(r["piece"] == 0 for r in found["packed"]) == edge.count()
    held = Counter()
    for r in found["packed"]:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048


def test_near_copies_keep_one_of_each_group_of_null_and_equal_ids(spark, docs, sf):
    a, b, c, d = ("".join(f"{name}{k * k} " for k in range(60)) for name in ("ant", "bee", "cat", "dog"))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (5, d), (None, c), (3, d.upper())]
    made = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in rows], docs.schema).repartition(3)
    found = NAMED["near_copies"](spark, made, sf)
    assert found.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in found.collect())) == sorted([(0, a), (0, b), (5, c), (3, d.upper())])
