"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed by a rolling polynomial; of each
window of ``WINDOW`` hashes the least is chosen, the rightmost of equals, and
kept with its position once. A passage of ``GRAM + WINDOW - 1`` code points or
more that two texts share then always gives them a common hash.

Texts are walked in overlapping stretches, so memory doesn't grow with their
length. Defined results: a null text is empty and has no hashes; a text
shorter than ``GRAM`` has one, of the whole text at position 0; one shorter
than a window has the least of what it has. The likeness of two fingerprints
is Dice's coefficient of their sets of hashes, 1 for two without any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 8
WINDOW = 16
#: Hashes in one numpy pass; their positions in it take 20 bits beside 44 of the hash.
PASS = (1 << 20) - WINDOW
BASE = 0x100000001B3
_LOW = np.uint64((1 << 20) - 1)
_WEIGHTS = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(GRAM)]


def _hashes(points: np.ndarray) -> np.ndarray:
    """The mixed hash of each run of GRAM code points."""
    n = len(points) - GRAM + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for k, weight in enumerate(_WEIGHTS):
        rolled += points[k : k + n] * weight
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    return rolled


def _chosen(hashed: np.ndarray) -> np.ndarray:
    """Positions of the rightmost least hash of each window, each once."""
    n = len(hashed)
    places = _LOW - np.arange(n, dtype=np.uint64)
    keys = (hashed & ~_LOW) | places
    if n <= WINDOW:
        return np.array([int(_LOW - (keys.min() & _LOW))])
    padded = np.full(-(-n // WINDOW) * WINDOW, ~np.uint64(0))
    padded[:n] = keys
    blocks = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    changes = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return (_LOW - (least[changes] & _LOW)).astype(np.int64)


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes of ``text`` and their positions."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(points) < GRAM:
        whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([whole & ~int(_LOW)], dtype=np.uint64), np.zeros(1, np.int64)
    hashes, places = [], []
    for start in range(0, max(1, len(points) - GRAM - WINDOW + 2), PASS):
        hashed = _hashes(points[start : start + PASS + WINDOW - 1 + GRAM - 1].astype(np.uint64))
        at = _chosen(hashed)
        if places and places[-1][-1] == at[0] + start:
            at = at[1:]
        hashes.append(hashed[at] & ~_LOW)
        places.append(at + start)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice's coefficient of two sorted sets."""
    if not len(a) and not len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """A short name of a fingerprint: of its hashes with their positions."""
    return hashlib.blake2b(hashes.tobytes() + places.tobytes(), digest_size=16).hexdigest()


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint``, an array of (hash, position), to every row of ``df``."""
    rest = df.drop("fingerprint")
    at = rest.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("position", T.LongType())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for value in batch.column(at).to_pylist():
                hashes, places = winnow(value or "")
                lists.append([{"hash": h, "position": p} for h, p in zip(hashes.view(np.int64).tolist(), places.tolist())])
            new = pa.array(lists, pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, "fingerprint"])

    return rest.mapInArrow(found, T.StructType([*rest.schema.fields, T.StructField("fingerprint", kind)]))


#: Rows in a bucket of consecutive ids; the number of buckets is bounded for the driver.
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows dealt to buckets of consecutive ids, sorted, each bucket followed by the first row of the next.

    Columns: ``bucket``, ``ahead`` (true: the row that follows the bucket), ``doc_id``, ``text``.
    The driver holds two numbers for each bucket.
    """
    count = docs.count()
    wanted = min(MOST_BUCKETS, max(1, count // BUCKET_ROWS))
    ids = docs.select(F.col(doc_id).cast("double").alias("at"))
    cuts = sorted(set(ids.approxQuantile("at", [k / wanted for k in range(1, wanted)], 0.2 / wanted if wanted < 2000 else 1e-4))) if wanted > 1 else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(doc_id).cast("double").alias("at"))
    if cuts:
        dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="cut", handleInvalid="keep")
        rows = dealt.transform(rows).withColumn("bucket", F.when(F.col("at").isNull(), -1).otherwise(F.col("cut").cast("int"))).drop("cut", "at")
    else:
        rows = rows.withColumn("bucket", F.lit(0)).drop("at")
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect())
    before = {heads[k][0]: heads[k - 1][0] for k in range(len(heads))}
    links = docs.sparkSession.createDataFrame([(b, head, before[b]) for b, head in heads], f"bucket int, head {rows.schema['doc_id'].dataType.simpleString()}, before int")
    # Of rows that share a bucket's first id, the one that sorts first goes to the bucket before.
    tagged = rows.withColumn("tie", F.xxhash64("text")).join(F.broadcast(links), "bucket")
    first = Window.partitionBy("bucket").orderBy("tie", "text")
    ahead = tagged.where(F.col("doc_id").eqNullSafe(F.col("head"))).withColumn("k", F.row_number().over(first)).where("k = 1")
    both = tagged.select("bucket", F.lit(False).alias("ahead"), "doc_id", "text", "tie").unionByName(ahead.select(F.col("before").alias("bucket"), F.lit(True).alias("ahead"), "doc_id", "text", "tie"))
    sorts = ["bucket", "ahead", "doc_id", "tie", "text"]
    return both.repartition("bucket").sortWithinPartitions(*sorts).select("bucket", "ahead", "doc_id", "text")


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edit_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, and likenesses to that edit and that document.

    The edit replaces the last quarter of the code points by as many of the
    next document's first (ascending id; after the last the first). Rows of
    equal id are ordered by a hash of their text, null ids come first.
    """
    rows = in_order(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType

    def told(row: tuple, following: tuple) -> tuple:
        _, own, (hashes, places), known = row
        edited = _edited(own, following[1])
        edit_hashes, edit_places = winnow(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return row[0], len(own), sha, digest(hashes, places), digest(edit_hashes, edit_places), likeness(known, np.unique(edit_hashes)), likeness(known, following[3])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for batch in batches:
            out = []
            for at, ahead, key, own in zip(*(c.to_pylist() for c in batch.columns)):
                own = own or ""
                found = winnow(own)
                row = (key, own, found, np.unique(found[0]))
                if last is not None and at == bucket:
                    out.append(told(last, row))
                last, bucket = (None if ahead else row), at
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t()) for n, t in (("n_chars", T.LongType), ("edited_sha256", T.StringType), ("fingerprint", T.StringType), ("edited_fingerprint", T.StringType), ("near_edited", T.DoubleType), ("near_next", T.DoubleType)))])
    arrow = pa.schema([("doc_id", batch_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return rows.mapInArrow(walk, schema)


def batch_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark hands over an id."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
