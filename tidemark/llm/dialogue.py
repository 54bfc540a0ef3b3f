"""Repair of conversation structure by cheapest edits.

Rows of a conversation, by turn, are read by an automaton of the role
initials ``(s?(ua)+)?``. Keep costs 0, Rerole 1, Delete 2, Insert 5, a
truncated row that stays 5 more; blank and repeated rows must go. Nodes are
(rows read, state); forward and backward minimum costs tell which arcs are
tight, that is, on some cheapest path, and a walk from the first node takes
the least letter among the tight arcs of its frontier at each step.

Costs compose over stretches of rows, so a conversation is never gathered.
Rows are range-partitioned by conversation and turn; conversations that lie
within a partition are repaired as they stream by. The rest, cut at partition
borders or longer than a block, become blocks: first rows of each text across
blocks by a window, a matrix of costs a block, a scan of matrices a
conversation, the walk inside each block from every state that is tight at
its start, a scan of states, and last the hash of the repaired blocks in
order, which streams. A scan holds a few numbers for each block.

Defined results: null ids, roles and texts are one space when rows are
damaged, so a null text is blank; a null id is a conversation of its own. Rows
of equal turn are ordered by role, a hash of the text and the text. Roles are
told by their first letter; another one than s, u or a can't be kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.storage import Kept, Working

SPACES = " \t\n\x0b\x0c\r"
FINE, BLANK, REPEATED, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
#: Most rows and code points of a block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
NEVER = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads to, by state, and where a turn of the due speaker does.
READ = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = (USER, USER, ASSISTANT, USER)
#: Cost and letters from a state to the end once all rows are read.
CLOSING = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}


def _arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """Arcs that read a row: letter, from, to, cost."""
    found = [("D", q, q, DELETE) for q in STATES]
    if fault in (FINE, TRUNCATED):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        found += [("K", q, to, KEEP + more) for q, to in READ.get(initial, {}).items()]
        found += [("R", q, DUE[q], REROLE + more) for q in STATES]
    return found


ARCS = {(initial, fault): _arcs(initial, fault) for initial in "suax" for fault in range(4)}
INSERTS = [("I", q, DUE[q], INSERT) for q in STATES]


def _inserted(costs: list[int]) -> list[int]:
    """Forward costs of a layer once insertions are allowed."""
    user = min(costs[USER], costs[START] + INSERT, costs[SYSTEM] + INSERT, costs[ASSISTANT] + INSERT)
    return [costs[START], costs[SYSTEM], user, min(costs[ASSISTANT], user + INSERT)]


def _onward(costs: list[int], arcs: list) -> list[int]:
    """Forward costs past one row."""
    after = [NEVER] * 4
    for _, q, to, cost in arcs:
        if costs[q] + cost < after[to]:
            after[to] = costs[q] + cost
    return after


def _backward(costs: list[int], arcs: list) -> list[int]:
    """Costs to the end before one row, insertions ahead of it included."""
    before = [NEVER] * 4
    for _, q, to, cost in arcs:
        if costs[to] + cost < before[q]:
            before[q] = costs[to] + cost
    user = min(before[USER], before[ASSISTANT] + INSERT)
    said = min(before[ASSISTANT], before[USER] + INSERT)
    return [min(before[START], user + INSERT), min(before[SYSTEM], user + INSERT), user, said]


def matrix(initials: str, faults: bytes) -> list[list[int]]:
    """Least cost from each state before the rows to each state after them."""
    rows = [[0 if q == s else NEVER for q in STATES] for s in STATES]
    for kind in zip(initials, faults):
        rows = [_onward(_inserted(costs), ARCS[kind]) for costs in rows]
    return [[min(c, NEVER) for c in costs] for costs in rows]


def walks(initials: str, faults: bytes, ahead: list[int], behind: list[int], total: int) -> list[tuple[str, int] | None]:
    """By start state the least letters over these rows and the state they end in; None if no cheapest path starts there.

    ``ahead`` are the costs from the conversation's start to these rows,
    ``behind`` those from their end to the conversation's.
    """
    arcs = [ARCS[kind] for kind in zip(initials, faults)]
    forward, back = [_inserted(ahead)], [behind]
    for own in arcs[:-1]:
        forward.append(_inserted(_onward(forward[-1], own)))
    for own in reversed(arcs):
        back.append(_backward(back[-1], own))
    back.reverse()
    tight = []
    for k, own in enumerate(arcs):
        least, to_end = forward[k], back[k + 1]
        here: dict[int, list[tuple[str, int]]] = {}
        for letter, q, to, cost in own:
            if least[q] + cost + to_end[to] == total:
                here.setdefault(q, []).append((letter, to))
        for letter, q, to, cost in INSERTS:
            if least[q] + cost + back[k][to] == total:
                here.setdefault(q, []).append((letter, to))
        tight.append(here)
    found: list[tuple[str, int] | None] = []
    for start in STATES:
        if ahead[start] + back[0][start] != total:
            found.append(None)
            continue
        letters, frontier = [], {start}
        for here in tight:
            letter = "I"
            while letter == "I":
                steps = [step for q in frontier for step in here.get(q, ())]
                letter = min(step[0] for step in steps)
                frontier = {to for taken, to in steps if taken == letter}
                letters.append(letter)
        # A letter leads from a state to one state only, so the frontier is one.
        found.append(("".join(letters), frontier.pop()))
    return found


@lru_cache(maxsize=100_000)
def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """Least cost of a whole conversation and the least letters that reach it."""
    back = list(CLOSING)
    for kind in zip(reversed(initials), reversed(faults)):
        back = _backward(back, ARCS[kind])
    letters, state = walks(initials, faults, [0, NEVER, NEVER, NEVER], list(CLOSING), back[START])[START]
    return back[START], letters + "I" * (CLOSING[state] // INSERT)


def edited(letters: str, rows: Iterable[tuple[str, str]], state: int) -> list[str]:
    """The repaired ``role:text`` of rows from ``state`` on."""
    out, rows = [], iter(rows)
    for letter in letters:
        role, text = (ROLES[DUE[state]], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = READ[_initial(role)][state]
        else:
            state = DUE[state]
            role = ROLES[state]
        out.append(f"{role}:{text}")
    return out


def _initial(role: str) -> str:
    return role[0] if role and role[0] in "sua" else "x"


def _unlawful(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damaged(df: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) damaged by their hash; a dropped one stays as a row without a ``fault``."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    draw = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced[2].alias("role"), spaced[3].alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "draw", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    stays = F.col("draw") > 0
    rows = rows.select("conv_id", "turn", *(F.when(stays, F.col(c)).alias(c) for c in ("role", "text")), F.when(stays, fault).alias("fault"), "draw")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.select("*", times.alias("again")).drop("draw", "again")


def _struct(columns: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "array<long>": T.ArrayType(T.LongType()), "array<int>": T.ArrayType(T.IntegerType()), "array<string>": T.ArrayType(T.StringType()), "array<binary>": T.ArrayType(T.BinaryType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _with_conv(kind: T.StructType, conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *kind.fields])


def _schemas(conv: T.DataType) -> tuple[T.StructType, T.StructType]:
    """Of results, and of results or blocks."""
    done = _with_conv(_struct("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"), conv)
    block = _struct("place long, initials string, faults binary, keys array<binary>, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long")
    return done, T.StructType([*done.fields, *block.fields])


class _Segment:
    """Rows of one conversation within a partition, up to a block of them at a time."""

    def __init__(self, conv, opened: bool, most: tuple[int, int]):
        self.conv, self.opened, self.most, self.seen = conv, opened, most, set()
        self._empty()

    def _empty(self) -> None:
        self.initials, self.faults, self.keys, self.roles, self.texts, self.chars = [], bytearray(), [], [], [], 0
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str | None, text: str | None, fault: int | None) -> None:
        if fault is None:
            return
        key = None
        if fault != BLANK:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            if key in self.seen:
                key, fault = None, REPEATED
            else:
                self.seen.add(key)
        if turn is not None and (self.last is None or turn != self.last):
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        self.initials.append(_initial(role))
        self.faults.append(fault)
        self.keys.append(key)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.texts) >= self.most[0] or self.chars >= self.most[1]

    def block(self, place: int) -> tuple:
        made = (self.conv, *[None] * 8, place, "".join(self.initials), bytes(self.faults), self.keys, self.roles, self.texts, self.first, self.last, self.turns)
        self.opened = True
        self._empty()
        return made

    def repaired(self) -> tuple:
        initials, faults = "".join(self.initials), bytes(self.faults)
        cost, audit = cheapest(initials, faults)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        lines = "\n".join(edited(audit, zip(self.roles, self.texts), START))
        counts = (gaps, faults.count(BLANK), faults.count(REPEATED), faults.count(TRUNCATED), _unlawful(initials), cost)
        return (self.conv, *counts, audit, hashlib.sha256(lines.encode()).hexdigest(), *[None] * 9)


def _streamed(schema: pa.Schema, most: tuple[int, int]):
    """Repairs conversations inside a partition; gives blocks of those at its borders and of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, own, out = TaskContext.get().partitionId() << 32, 0, None, []
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or conv != own.conv:
                    if own is not None:
                        out.append(own.block(base + count) if own.opened else own.repaired())
                        count += 1
                    own = _Segment(conv, own is None, most)
                elif own.full():
                    out.append(own.block(base + count))
                    count += 1
                own.add(*row)
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
        if own is not None:
            out.append(own.block(base + count))
        yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


MEASURES = _struct("place long, initials string, faults binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long")
SCANNED = _struct("place long, ahead array<long>, behind array<long>, total long, gaps long, blank long, duplicate long, truncated long, illegal long, final boolean")
WALKED = _struct("place long, total long, gaps long, blank long, duplicate long, truncated long, illegal long, final boolean, letters array<string>, ends array<int>")
CHOSEN = _struct("place long, state int")
PIECES = _struct("place long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines binary")


def _mapped(df: DataFrame, one, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` by ``one`` from each row of ``df``, its columns as arguments."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield _batch([one(*row) for row in zip(*(c.to_pylist() for c in part.columns))], arrow)

    return df.mapInArrow(run, schema)


def _measure(conv, place: int, initials: str, faults: bytes, first, last, turns, repeated: list[int] | None) -> tuple:
    own = bytearray(faults)
    for k in repeated or ():
        own[k] = REPEATED
    costs = [c for row in matrix(initials, own) for c in row]
    return conv, place, initials, bytes(own), costs, own.count(BLANK), own.count(REPEATED), own.count(TRUNCATED), _unlawful(initials), first, last, turns


def _scan(blocks: pa.Table) -> pa.Table:
    """Costs ahead of and behind each block of one conversation, and its counts."""
    rows = sorted(blocks.to_pylist(), key=lambda r: r["place"])
    costs = [np.array(r["costs"], np.int64).reshape(4, 4) for r in rows]
    ahead, behind = [np.array([0, NEVER, NEVER, NEVER])], [np.array(CLOSING)]
    for own in costs[:-1]:
        ahead.append(np.minimum((ahead[-1][:, None] + own).min(axis=0), NEVER))
    for own in reversed(costs):
        behind.append(np.minimum((own + behind[-1]).min(axis=1), NEVER))
    behind.reverse()
    ends = [(r["first"], r["last"]) for r in rows if r["first"]]
    illegal = sum(r["illegal"] for r in rows) + sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
    timed = [r for r in rows if r["first_turn"] is not None]
    turns = sum(r["turns"] for r in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
    counts = (gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal)
    found = [(rows[0]["conv_id"], r["place"], ahead[k].tolist(), behind[k + 1].tolist(), int(behind[0][START]), *counts, k == len(rows) - 1) for k, r in enumerate(rows)]
    return pa.Table.from_batches([_batch(found, to_arrow_schema(SCANNED).insert(0, blocks.schema.field("conv_id")))])


def _walk(conv, place: int, initials: str, faults: bytes, ahead: list[int], behind: list[int], total: int, *counts) -> tuple:
    found = walks(initials, faults, ahead, behind, total)
    return conv, place, total, *counts, [f and f[0] for f in found], [f and f[1] for f in found]


def _choose(blocks: pa.Table) -> pa.Table:
    """The state in which the walk enters each block of one conversation."""
    state, found = START, []
    for place, ends in sorted(zip(blocks["place"].to_pylist(), blocks["ends"].to_pylist())):
        found.append((place, state))
        state = ends[state]
    return pa.Table.from_batches([_batch(found, to_arrow_schema(CHOSEN))])


def _piece(conv, place: int, total: int, gaps: int, blank: int, duplicate: int, truncated: int, illegal: int, final: bool, letters: list[str], ends: list[int], state: int, roles: list[str], texts: list[str]) -> tuple:
    """A block's letters and repaired lines, each line after a line end."""
    audit = letters[state] + "I" * (CLOSING[ends[state]] // INSERT if final else 0)
    lines = "".join(f"\n{line}" for line in edited(audit, zip(roles, texts), state))
    return conv, place, gaps, blank, duplicate, truncated, illegal, total, audit, lines.encode()


def _joined(schema: pa.Schema):
    """One row for each conversation from its pieces in order; lines are hashed as they stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, letters, hashed, begun = None, None, [], None, False
        for batch in batches:
            out = []
            for conv, _, *own, audit, lines in zip(*(c.to_pylist() for c in batch.columns)):
                if counts is None or conv != last:
                    if counts is not None:
                        out.append((last, *counts, "".join(letters), hashed.hexdigest()))
                    last, counts, letters, hashed, begun = conv, own, [], hashlib.sha256(), False
                letters.append(audit)
                hashed.update(lines if begun else lines[1:])
                begun = begun or bool(lines)
            yield _batch(out, schema)
        if counts is not None:
            yield _batch([(last, *counts, "".join(letters), hashed.hexdigest())], schema)

    return run


def _of_blocks(blocks: DataFrame, done: T.StructType) -> DataFrame:
    """Repairs conversations that come in blocks."""
    conv = done["conv_id"].dataType
    keys = blocks.select("conv_id", "place", F.posexplode("keys").alias("row", "key")).where("key is not null")
    first = Window.partitionBy("conv_id", "key")
    repeated = keys.withColumn("first", F.min("place").over(first)).where("place > first").groupBy("place").agg(F.collect_list("row").alias("repeated"))
    narrow = blocks.select("conv_id", "place", "initials", "faults", "first_turn", "last_turn", "turns").join(repeated, "place", "left")
    measured = Kept(_mapped(narrow.select("conv_id", "place", "initials", "faults", "first_turn", "last_turn", "turns", "repeated"), _measure, _with_conv(MEASURES, conv)), "dialogue_measures").df
    ends = measured.select("*", F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("last")).drop("initials", "faults")
    scanned = ends.groupBy("conv_id").applyInArrow(_scan, _with_conv(SCANNED, conv)).drop("conv_id")
    both = measured.select("conv_id", "place", "initials", "faults").join(scanned, "place").select("conv_id", "place", "initials", "faults", *SCANNED.names[1:])
    walked = Kept(_mapped(both, _walk, _with_conv(WALKED, conv)), "dialogue_walks").df
    chosen = walked.select("conv_id", "place", "ends").groupBy("conv_id").applyInArrow(_choose, CHOSEN)
    texts = walked.join(chosen, "place").join(blocks.select("place", "roles", "texts"), "place").select("conv_id", *WALKED.names, "state", "roles", "texts")
    pieces = _mapped(texts, _piece, _with_conv(PIECES, conv))
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined(to_arrow_schema(done)), done)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each conversation of ``damaged`` rows: its faults, the cheapest edits and the hash of what they give.

    ``block_rows`` and ``block_chars`` bound what is held of a conversation at once, with equal results.
    """
    done, either = _schemas(rows.schema["conv_id"].dataType)
    # Equal rows are interchangeable; a number of their own lets them lie in several partitions.
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "hash"]
    ranged = keyed.repartitionByRange(*order, "number").sortWithinPartitions(*order, "text", "number")
    with Working() as work:
        first = Kept(ranged.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_streamed(to_arrow_schema(either), (block_rows, block_chars)), either), "dialogue")
        found = _of_blocks(first.df.where("place is not null"), done)
        result = Kept(first.df.where("place is null").select(*done.names).unionByName(found), "dialogue_repaired")
        return work.spare(result)
