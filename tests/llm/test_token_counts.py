import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    return lambda text: len(found.encode(text or "", add_special_tokens=False).ids)


def test_documents_have_the_counts_of_the_library(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text, n = docs[r["doc_id"]] or "", library(docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_hard_texts(library):
    """Special strings, long runs, every plane, code points newer than the library's tables."""
    counter, rng = token_counts.merges(PATH), random.Random(3)
    letters = [chr(c) for c in (*range(0x20, 0x250), 0x558, 0x1C, 0x85, 0x301, 0x3042, 0x200B, 0x2028, 0x4E00, 0xA7CE, 0x1F600, 0x31350, 0x10FFFF)]
    texts = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "  \n\n x  ", " " * 5000, "a" * 30_000, "ab" * 9000, "\n" * 777, "don't we'LL 'S's", "\r\n\t x"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(400)] + ["".join(rng.choices("ab \n'st", k=200)) for _ in range(100)]
    assert [counter.of_text(t) for t in texts] == [library(t) for t in texts]


def test_every_letter_and_digit_is_the_librarys():
    counter, library = token_counts.merges(PATH), Tokenizer.from_file(PATH).pre_tokenizer
    for start in range(0, 0x110000, 0x800):
        if start == 0xD800:
            continue
        text = "\n".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in range(start, start + 0x800))
        pattern = counter.exact if counter.doubtful.search(text) else counter.words
        assert [m.span() for m in pattern.finditer(text)] == [span for _, span in library.pre_tokenize_str(text)], hex(start)


def test_words_in_batches_and_forgotten(library, monkeypatch):
    text = " ".join(f"word{k} der 7 x" for k in range(300))
    for name, value in (("LONG", 10), ("BATCH", 3), ("KNOWN", 5), ("SHORT", 4)):
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.Merges(PATH)
    assert counter.of_text(text) == library(text) and len(counter.known) <= 5


def test_merges_match_a_plain_search():
    """The lowest-ranked pair, leftmost of equals, until no pair is known."""
    counter, rng = token_counts.merges(PATH), random.Random(5)
    for _ in range(300):
        word = bytes(rng.choices(b" theandingr\xc3\xa9", k=rng.randint(0, 40)))
        symbols = list(word)
        while pairs := [(counter.ranks[a << 32 | b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in counter.ranks]:
            rank, k = min(pairs)
            symbols[k : k + 2] = [counter.made[rank]]
        assert counter.of_bytes(word) == len(symbols)


def test_edges(spark, edge, nothing, library):
    clash = edge.selectExpr("*", "'x' as n_tokens")
    got = token_counts.count_tokens(clash, PATH, limit=3)
    assert got.columns == [*edge.columns, "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == edge.count()
    for r in rows:
        n = library(r["text"])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 3)
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))
