import re
from itertools import combinations

import pytest
from xxhash import xxh64_intdigest

from tidemark.llm import queries
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import fingerprint_links, near_duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashed = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def roots(nodes, links):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_matches_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = roots(sorted(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = queries.op3_simhash(spark, sf).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {d: (prints[d], want[d]) for d in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_near_fingerprints(spark, seed):
    import random

    rng = random.Random(seed)
    prints = set()
    for _ in range(60):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            prints.add(at)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << bit
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    found = [(r["u"], r["v"]) for r in fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert {frozenset(p) for p in found} <= {frozenset(p) for p in pairs}
    assert roots(signed, found) == roots(signed, pairs)


def test_components_of_a_path_a_star_and_a_pair(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, 7000), (7000, 7000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: r for n, r in roots(sorted({n for l in links for n in l}), links).items()}


def test_edges(edge, nothing):
    rows = near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {by_id[k]["fp"] for k in (0, 1, 2)} == {0} and {by_id[k]["component_id"] for k in (0, 1, 2)} == {0}
    assert by_id[6]["component_id"] == 5 and by_id[8]["component_id"] == 7
    assert near_duplicates(nothing).count() == 0
