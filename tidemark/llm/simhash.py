"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link at ``RADIUS`` (3) or fewer differing bits.
They meet in the middle: each emits the variants within half the radius, one
rounds the half down to 1 and the other up to 2. Of two fingerprints at an odd
distance one has an odd number of set bits, so only those of odd parity emit
the larger ball; and of three differing bits two lie in the same half of the
word, so of the variants at distance 2 only the 992 with both flips in one
half are needed. Then

* at distance 1 or 2 both emit a common variant at distance 1 or less, and all
  fingerprints that emit a variant in this way are within 2 of each other;
* at distance 3 the even one emits a variant at distance 1 that the odd one
  emits at distance 2.

So in a group of equal variants, links from all members to the least of the
near ones give the same components as all pairs would, and no pair list is
built. A group is bounded by geometry: at most 65 near and 992 far members,
as equal fingerprints are one class before.

Fingerprints with no possible partner are set aside first: within 3 bits, one
32-bit half differs in one bit at most. That needs 1 key for a half of even
parity and 33 for one of odd parity. It only saves work: what meets another by
chance is let go by two splits, into bits by turns and by place. The larger
ball is emitted only for the sides where an even one is near.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with equal ids keep their own fingerprints; the id of a component
is the least non-null one in it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tidemark.llm.components import connected_components
from tidemark.llm.storage import Kept, Working, keep

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCK = 1 << 15


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


NEAR = [0, *(_signed(1 << i) for i in range(64))]
#: Both flips in the lower half, and in the upper half.
FAR = [[_signed(1 << i | 1 << j) for i in range(half, half + 32) for j in range(half, i)] for half in (0, 32)]
#: Halves of the word, by turns and by place.
SPLITS = (0x5555555555555555, 0xFFFFFFFF)


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the XXH64 of all shingles, as a signed long."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    begins, stops = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashed = [xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begins[at : at + BLOCK], stops[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashed, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as long ``name``; the text is handed over as bytes and dropped."""
    rest = df.drop(name).withColumn("_bytes", F.col(text).cast("binary")).drop(text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], name])

    schema = T.StructType([*rest.schema.fields[:-1], T.StructField(name, T.LongType())])
    return rest.mapInArrow(hashed, schema)


def _masks(values: list[int], kind: str = "long"):
    return F.array(*[F.lit(v).cast(kind) for v in values])


def _with_partner(prints: DataFrame, mask: int) -> DataFrame:
    """The fingerprints of which the half of bits in ``mask``, or the other half, is within one bit of another's; ``even0`` and ``even1`` tell whether of one of even parity."""
    each = []
    for side, bits in enumerate((mask, ~mask)):
        flips = [0, *(_signed(1 << i) for i in range(64) if bits >> i & 1)]
        half = F.col("fp").bitwiseAND(F.lit(_signed(bits % (1 << 64))))
        flip = F.when(F.bit_count(half) % 2 == 1, _masks(flips)).otherwise(_masks([0]))
        each.append(prints.select("fp", F.lit(side).alias("side"), half.alias("half"), F.explode(flip).alias("flip")))
    keys = each[0].unionByName(each[1]).select("fp", "side", F.col("half").bitwiseXOR(F.col("flip")).alias("key"))
    of_key = Window.partitionBy("side", "key")
    several = keys.withColumn("n", F.count("*").over(of_key)).withColumn("even", F.max(F.bit_count("fp") % 2 == 0).over(of_key)).where("n > 1")
    return several.groupBy("fp").agg(*[F.max((F.col("side") == side) & F.col("even")).alias(f"even{side}") for side in (0, 1)])


def _variants(prints: DataFrame) -> DataFrame:
    """Variants (``fp, near, variant``) that make all distinct ``fp`` within the radius meet.

    Two at distance 3 are of different parity. The odd one flips two bits only
    in the half other than one that it has in common, but for a bit, with an
    even one.
    """
    some = prints.withColumn("may", F.lit(True))
    for mask in SPLITS:
        last = some.select("fp", "may").join(_with_partner(some.select("fp"), mask), "fp")
        some = keep(last.select("fp", "even0", "even1", (F.col("may") & (F.col("even0") | F.col("even1"))).alias("may")), "partnered")
    near = some.select("fp", F.lit(True).alias("near"), F.explode(_masks(NEAR)).alias("flip"))
    lower, upper = FAR
    flips = F.when(F.col("even0") & F.col("even1"), _masks(lower + upper)).when(F.col("even0"), _masks(upper)).otherwise(_masks(lower))
    far = some.where("may").where(F.bit_count("fp") % 2 == 1).select("fp", F.lit(False).alias("near"), F.explode(flips).alias("flip"))
    return near.unionByName(far).select("fp", "near", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Verified links (u, v) that connect all distinct ``fp`` within the radius."""
    variants = _variants(prints)
    met = variants.withColumn("centre", F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant")))
    pairs = met.where("centre is not null and centre <> fp").select(F.col("fp").alias("u"), F.col("centre").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def _rooted(prints: DataFrame) -> DataFrame:
    """Each distinct ``fp`` with the ``root`` of its component."""
    classes = keep(prints.select("fp").distinct(), "classes")
    parts = keep(connected_components(fingerprint_links(classes)), "parts")
    return classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component, also for those of null ids only: the first by id (nulls last), hash of the text, text and the other columns."""
    with Working() as work:
        hashed = keep(with_fingerprint(df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))), "fingerprints")
        own = hashed.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
        chosen = own.join(_rooted(hashed), "fp").groupBy("root").agg(F.min("first").alias("first")).select("root", "first.id", "first.th")
        firsts = work.spare(Kept(chosen, "firsts"))
    named = df.withColumn("_th", F.xxhash64(text))
    found = named.join(firsts, named[doc_id].eqNullSafe(firsts["id"]) & (named["_th"] == firsts["th"]))
    rest = [c for c in df.columns if c not in (doc_id, text)]
    return found.groupBy("root").agg(F.min(F.struct(text, doc_id, *rest)).alias("row")).select(*[F.col("row")[c].alias(c) for c in df.columns])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``df``."""
    with Working() as work:
        hashed = work.spare(Kept(with_fingerprint(df.select(doc_id, text), text), "fingerprints"))
        classes = keep(hashed.groupBy("fp").agg(F.min(doc_id).alias("least")), "classes")
        parts = keep(connected_components(fingerprint_links(classes.select("fp"))), "parts")
        rooted = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        labels = work.spare(Kept(rooted.join(least, "root").select("fp", "component_id"), "labels"))
    return hashed.join(labels, "fp").select(doc_id, "fp", "component_id")
