import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def check(rows, docs):
    """Pieces are exact, sequences gapless and not over length."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == dict(docs).keys()
    for doc, text in docs:
        ids = plain_ids(text)
        parts = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // 2048)))
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_round_trip_and_few_sequences(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op9_packing(spark, sf).collect()
    assert check(rows, docs) <= 1.03 * -(-sum(r["length"] for r in rows) // 2048)


def test_words_have_the_ids_of_the_whole_text():
    words = packing._Words(PATH)
    for text in ["İstanbul ǅ Straße STRASSE", "don't ﬁne x​y", "日本語 テスト", "école École É", "A.B.C... ?! \x85a Σας ΣΑΣ", " \n\t ", "", "a\x1cb", "<|endoftext|> x<|startoftext|>y", "½ Ⅷ ŉa"]:
        assert words.document(text) == plain_ids(text).tobytes(), text


def test_crossover_keeps_every_piece_once():
    rng = random.Random(4)
    sizes = [rng.randint(1, 2047) for _ in range(300)]
    people = packing.evolve(sizes, [], rng, 2048, 6)
    for person in people:
        items = [i for group in person.bins.values() for i in group]
        assert sorted(items) == list(range(300)) and min(person.left.values()) >= 0
    first = packing.Packing(sizes, 2048)
    first.add(list(range(300)))
    assert len(people[0].bins) <= len(first.bins)


def test_edges(spark, edge, nothing):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    check(packing.pack(packing.tokenized(docs, PATH)).collect(), [tuple(r) for r in docs.collect()])
    repeated = packing.pack(packing.tokenized(edge, PATH))
    assert repeated.where("piece = 0").count() == edge.count()
    assert packing.pack(packing.tokenized(nothing, PATH)).count() == 0
