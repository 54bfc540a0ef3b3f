import math
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import langid, queries


def test_held_out_accuracy(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    out = rows.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(out) > 50
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    assert rows.where("score < 0 or score > 1 or score is null").isEmpty()


def test_edges(edge, nothing):
    model = langid.train(edge)
    found = langid.identify(edge.withColumnRenamed("shard", "score"), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "fit"]
    by_text = {r["text"]: r for r in found.collect()}
    for text in (None, "", "   \n\t", "7 7 7"):
        assert by_text[text]["lang_pred"] == "und" and by_text[text]["score"] == 0 and by_text[text]["fit"] is None
    assert by_text["one word"]["lang_pred"] == "en"
    assert langid.identify(nothing, model).count() == 0
    nobody = langid.identify(edge, langid.train(nothing))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}


def test_long_texts_are_read_whole(monkeypatch):
    texts = ["abc" * 50 + " déjà vu " * 40, "x"]
    model = (["a", "b"], np.random.default_rng(0).random((2, langid.BUCKETS + 1)), [0.0, 0.0])
    model[1][:, -1] = 0
    whole = langid.score_texts(texts, *model)
    monkeypatch.setattr(langid, "PASS", 37)
    parts = langid.score_texts(texts, *model)
    assert whole[0] == parts[0] and abs(whole[2] - parts[2]).max() < 1e-9


def bucket(points):
    """The bucket of an n-gram, in plain numbers."""
    mix, word = [int(m) for m in langid.MIX], 2**32
    h = points[0] * mix[0] % word
    for p in points[1:]:
        h = ((h ^ (h >> 15)) * mix[1] + p * mix[2]) % word
    h ^= h >> 13
    return ((h * mix[1] + len(points)) % word) >> 16


def grams(text):
    points = [ord(c) for c in f" {text.lower()} "]
    return Counter(bucket(points[k : k + n]) for n in langid.ORDERS for k in range(len(points) - n + 1))


def test_matches_plain_naive_bayes(spark, sf):
    rows = [(r["doc_id"], r["text"][:1500], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned, prior = {}, Counter()
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and lang is not None:
            learned.setdefault(lang, Counter()).update(grams(text))
            prior[lang] += 1
    sizes = {lang: sum(own.values()) + langid.ALPHA * langid.BUCKETS for lang, own in learned.items()}
    got = {r["doc_id"]: r for r in langid.identify(table, langid.train(table.where(~langid.held_out(table["doc_id"])))).collect()}
    for doc_id, text, _ in rows:
        if not any(c.isalpha() for c in text):
            continue
        own = grams(text)
        odds = {lang: math.log(prior[lang] / sum(prior.values())) + sum(n * math.log((learned[lang][b] + langid.ALPHA) / sizes[lang]) for b, n in own.items()) for lang in learned}
        best = max(sorted(odds), key=odds.get)
        assert got[doc_id]["lang_pred"] == best
        assert math.isclose(got[doc_id]["score"], 1 / sum(math.exp(o - odds[best]) for o in odds.values()), rel_tol=1e-6)
