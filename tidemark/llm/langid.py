"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run inside Spark tasks on whole texts; what crosses the
driver is one count matrix of ``BUCKETS`` times the number of languages, which
is turned into log-probabilities and broadcast. Each batch of texts becomes a
sparse matrix in coordinate form (one entry an n-gram) and is multiplied with
the dense log-probabilities by a gather and a segmented sum in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is no labelled row to learn from. Equal posteriors
go to the language that sorts first. ``fit`` is the mean log-likelihood of an
n-gram above that of uniform noise; it is null where the language is ``und``.
Columns of the input that are named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Code points in one numpy pass, whatever the lengths of the texts.
PASS = 1 << 20
LETTER = regex.compile(r"\p{L}")
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of pieces of texts: row of each, code points with those that follow, number of own code points."""
    rows, parts, owns, size = [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or not LETTER.search(text):
            continue
        padded = f" {text.lower()} "
        for start in range(0, len(padded), PASS):
            part = padded[start : start + PASS + max(ORDERS) - 1]
            if rows and size + len(part) > PASS:
                yield rows, parts, owns
                rows, parts, owns, size = [], [], [], 0
            rows.append(row)
            parts.append(part)
            owns.append(min(PASS, len(padded) - start))
            size += len(part)
    if rows:
        yield rows, parts, owns


def _buckets(parts: list[str], owns: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each code point (BUCKETS: none there), and where each part begins."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hashed = points * MIX[0]
    for k in range(1, order):
        hashed[:-k] = (hashed[:-k] ^ (hashed[:-k] >> np.uint32(15))) * MIX[1] + points[k:] * MIX[2]
    hashed ^= hashed >> np.uint32(13)
    hashed = hashed * MIX[1] + np.uint32(order)
    found = (hashed >> np.uint32(16)).astype(np.int32)
    for begin, end, own in zip(begins, ends, owns):
        found[min(begin + own, max(begin, end - order + 1)) : end] = BUCKETS
    return found, begins


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
        for lang in langs:
            docs[lang] = docs.get(lang, 0) + 1
        for rows, parts, owns in _pieces(texts):
            of = np.array([langs[r] for r in rows])
            for lang in set(of):
                own = [k for k in range(len(rows)) if of[k] == lang]
                for order in ORDERS:
                    found, _ = _buckets([parts[k] for k in own], [owns[k] for k in own], order)
                    counts[lang] += np.bincount(found, minlength=BUCKETS + 1)
    for lang, row in counts.items():
        full = np.flatnonzero(row[:BUCKETS])
        n = len(full) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(row[full], docs[lang]))],
            names=["lang", "bucket", "n"],
        )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (a row for each bucket and one of zeros) and log-priors.

    The driver receives sums for each language and bucket; languages are a
    vocabulary of codes, so their number doesn't grow with the documents.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    docs = np.zeros(len(langs))
    for k, code in enumerate(langs):
        own = sums[sums["lang"] == code]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        docs[k] = own.loc[own["bucket"] < 0, "n"].sum()
    smooth = counts[:BUCKETS] + ALPHA
    logs = np.zeros_like(counts)
    logs[:BUCKETS] = np.log(smooth / smooth.sum(axis=0))
    return langs, logs, np.log(docs / max(docs.sum(), 1))


def score_texts(texts: list[str | None], langs: list[str], logs: np.ndarray, priors: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and fit of each text."""
    total = np.zeros((len(texts), len(langs)))
    grams = np.zeros(len(texts))
    if langs:
        for rows, parts, owns in _pieces(texts):
            for order in ORDERS:
                found, begins = _buckets(parts, owns, order)
                np.add.at(grams, rows, np.add.reduceat(found < BUCKETS, begins, dtype=np.int64))
                for k in range(len(langs)):
                    np.add.at(total[:, k], rows, np.add.reduceat(logs[k][found], begins))
    names, scores, fits = [], np.zeros(len(texts)), np.full(len(texts), np.nan)
    for row, n in enumerate(grams):
        if not n:
            names.append("und")
            continue
        odds = total[row] + priors
        best = int(np.argmax(odds))
        names.append(langs[best])
        scores[row] = 1 / np.exp(odds - odds[best]).sum()
        fits[row] = total[row, best] / n + np.log(BUCKETS)
    return names, scores, fits


def identify(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``fit`` to every row of ``df``."""
    langs, logs, priors = model
    shared = df.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T), priors))
    rest = df.drop("lang_pred", "score", "fit")
    at = rest.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, fits = score_texts(batch.column(at).to_pylist(), *shared.value)
            new = [pa.array(names, pa.string()), pa.array(scores), pa.array(fits, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "fit"])

    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    return rest.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
