import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import dialogue, queries

DUE = {0: 2, 1: 2, 2: 3, 3: 2}
TAKES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain_edits(initials, faults):
    """The first of all edit strings by cost, then letters."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, at, state = heapq.heappop(heap)
        if at == len(initials) and state in (0, 3):
            return cost, letters
        if (at, state) in seen:
            continue
        seen.add((at, state))
        heapq.heappush(heap, (cost + 5, letters + "I", at, DUE[state]))
        if at < len(initials):
            heapq.heappush(heap, (cost + 2, letters + "D", at + 1, state))
            if faults[at] in (0, 3):
                more = 5 * (faults[at] == 3)
                heapq.heappush(heap, (cost + 1 + more, letters + "R", at + 1, DUE[state]))
                if state in TAKES.get(initials[at], {}):
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, TAKES[initials[at]][state]))


def plain(rows):
    """Every conversation in plain Python, from (conv_id, turn, role, text); rows of equal turn must be alike."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if draw == 0:
                continue
            text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(draw, text)
            kept += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
        seen, faults = set(), []
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        cost, letters = plain_edits(initials, faults)
        lines, state, k = [], 0, 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else kept[k][1:]
            k += letter != "I"
            if letter == "D":
                continue
            state = TAKES[role[0]][state] if letter == "K" else DUE[state]
            lines.append(f"{role if letter == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_query_matches_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_dialogue_repair(spark, sf)) == plain(rows)


def test_edits_are_the_least_of_all():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(0, 9)
        initials = "".join(rng.choices("suax", [1, 4, 4, 1], k=n))
        faults = bytes(rng.choices(range(4), [6, 1, 1, 1], k=n))
        assert dialogue.cheapest(initials, faults) == plain_edits(initials, faults)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_long_conversations_in_blocks(spark, block):
    """One conversation holds most rows; repeats and pairs run across blocks and partitions."""
    rng = random.Random(block)
    texts = ["Yes.", "no", "Is it?", " ", "Go on!", "It is so.", "\n"]
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice(texts) if t % 2 else f"{t} goes on{rng.choice(['.', ''])}") for t in range(400) if t % 9]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(8, 60) for t in range(rng.randint(1, 6))]
    assert found(dialogue.repair(dialogue.damaged(made(spark, rows)), block_rows=block)) == plain(rows)


def test_tables_of_blocks_only(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c % 3} says {t % 4}.") for c in range(25) for t in range(7)]
    assert found(dialogue.repair(dialogue.damaged(made(spark, rows, 5)), block_chars=1)) == plain(rows)


def test_edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, dropped conversations, odd roles, no rows, clashing columns."""
    rows = [(None, None, None, None), (None, 3, "user", "Hello."), (1, None, "user", "First."), (1, 0, "assistant", None), (1, 5, None, "x."), (2, 1, "", ""), (2, 2, "unknown", "Kept as it begins with u."), (2, 3, "assistant", "long " * 50_000 + ".")]
    rows += [(3, 4, "user", "Same.")] * 9 + [(4, 0, "system", "only me."), (5, -3, "ärger", "É \x85"), (6, 10**12, "user", "Far!"), (6, -(10**12), "assistant", "Apart?")]
    rows += [(100 + k, 0, "user", "One.") for k in range(60)]
    got = found(dialogue.repair(dialogue.damaged(made(spark, rows).selectExpr("*", "'x' as fault", "1 as place", "2 as draw"))))
    assert got == plain(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    none = dialogue.repair(dialogue.damaged(made(spark, rows).where("1 = 0")))
    assert none.isEmpty() and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
