"""Variants made on dense groups of fingerprints."""

import random
from itertools import combinations

from tests.llm.test_near_duplicates import roots
from tidemark.llm import simhash


def signed(bits):
    return bits - (1 << 64) if bits >> 63 else bits


def test_far_variants_of_a_dense_group(spark):
    """Fingerprints of one parity are never three bits apart, and a common half says where two bits differ."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    flips = lambda places, n: sum(1 << b for b in rng.sample(places, n))
    even = {base ^ flips(range(64), 2) for _ in range(60)}
    assert len({p.bit_count() % 2 for p in even}) == 1
    lower = {base ^ flips(range(32), n) for n in (5, 6) for _ in range(12)}
    sizes = []
    for prints in (even, lower, even | lower):
        rows = spark.createDataFrame([(signed(p),) for p in sorted(prints)], "fp long")
        pairs = [(signed(a), signed(b)) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 3]
        found = [(r["u"], r["v"]) for r in simhash.fingerprint_links(rows).collect()]
        assert {frozenset(p) for p in found} <= {frozenset(p) for p in pairs}
        assert roots([signed(p) for p in prints], found) == roots([signed(p) for p in prints], pairs)
        sizes.append(simhash._variants(rows).where("not near").groupBy("fp").count().agg({"count": "max"}).first()[0] or 0)
    assert sizes[0] == 0 and sizes[1] <= 496 and sizes[2] <= 992
