import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tidemark.llm import fill_middle, queries

SENTINELS = ("<P>", "<S>", "<M>")


def plain(doc_id, text, rate=100, spm=50, seed=7):
    text, hashed = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_matches_its_sql(spark, sf):
    assert differences(queries.op11_fill_middle(spark, sf), connect(sf), queries.FILL_MIDDLE_SQL) == ""


def made():
    rng = random.Random(11)
    pieces = ["a", "\n", "\n\n", "<", "<P", "P>", "<S", "<<M", "é", "\U0001f600", "\x85", " ", "\r", "<P >", "long words"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(300)]
    return texts + ["<P>", "x<S>", "<<M>", "\n", "a", "a\n", None, "", "end<", "end<P", "<>\n<P\n>"]


@pytest.mark.parametrize("block", [fill_middle.BLOCK, 1, 2, 7])
def test_forms_of_texts_in_blocks(block, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    for k, text in enumerate(made()):
        hashed = hashlib.sha256(f"7:{k}".encode()).hexdigest()
        draws = tuple(int(hashed[j : j + 8], 16) for j in (0, 8, 16, 24))
        n, form, left, middle, out = fill_middle.transform((text or "").encode(), draws, rate=80)
        assert (n, form, left, middle, out.decode()) == plain(k, text, rate=80), (k, text)


def test_scan_counts_are_those_of_a_walk_of_the_table():
    for text in made():
        data, state, counts = (text or "").encode(), 0, [0, 0, 0]
        for byte in data:
            kind = fill_middle.KINDS[byte]
            for k, tell in enumerate((fill_middle.UNIT, fill_middle.POINT, fill_middle.SENTINEL)):
                counts[k] += bool(fill_middle.TELLS[state, kind] & tell)
            state = fill_middle.AFTER[state, kind]
        assert fill_middle.scan(np.frombuffer(data, np.uint8)).sum(axis=0).tolist() == counts
        assert counts == [len(re.findall(r"[^\n]*\n|[^\n]+", text or "")), len(text or ""), sum((text or "").count(s) for s in SENTINELS)]


def test_outputs_give_their_texts_back(spark):
    docs = spark.createDataFrame(list(enumerate(made())), "doc_id long, text string").repartition(3)
    found = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in found} == {"plain", "psm", "spm"} and len(found) == len(made())
    for r in found:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_edges(edge, nothing):
    clash = edge.selectExpr("*", "'x' as form", "1 as output")
    got = fill_middle.fill_in_middle(clash)
    assert got.columns == [*edge.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = got.collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert tuple(r[c] for c in got.columns[-5:]) == plain(r["doc_id"], r["text"])
    assert fill_middle.fill_in_middle(nothing).isEmpty()
    named = fill_middle.fill_in_middle(edge.selectExpr("doc_id as n", "text as output"), "n", "output")
    assert named.columns == ["n", "form", "prefix_chars", "middle_chars", "output"] and named.count() == edge.count()
