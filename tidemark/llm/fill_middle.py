"""Fill-in-the-middle transformation of documents cut at line ends.

A table-driven automaton over UTF-8 bytes tells units (lines with their end),
code points and sentinels apart in one scan, which counts its transitions; a
second pass finds the bytes of the two cuts in the blocks that hold them. The
automaton's state never depends on more than the last two bytes, so a block is
stepped as a whole by looking three classes up at a time; blocks of ``BLOCK``
bytes bound what a long text needs beside itself.

Defined results: a null text is empty and a null id is the empty string; an
empty text and one that holds a sentinel stay plain; columns of ``df`` named
like a new one are replaced. Rows are transformed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 20

# Classes of bytes, states of the automaton, and what a transition tells.
_OTHER, _NEWLINE, _OPENS, _NAMES, _CLOSES, _CONTINUES = range(6)
_FRESH, _INSIDE, _OPENED, _NAMED = range(4)
UNIT, POINT, SENTINEL = 1, 2, 4


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte; by state and class the next state and what the step tells."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[0x80:0xC0] = _CONTINUES
    kinds[[ord("\n"), ord("<"), ord(">")]] = _NEWLINE, _OPENS, _CLOSES
    kinds[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = _NAMES
    after = np.full((4, 6), _INSIDE, np.uint8)
    after[:, _NEWLINE], after[:, _OPENS], after[_OPENED, _NAMES] = _FRESH, _OPENED, _NAMED
    tells = np.zeros((4, 6), np.uint8)
    tells[_FRESH] |= UNIT
    tells[:, :_CONTINUES] |= POINT
    tells[_NAMED, _CLOSES] |= SENTINEL
    return kinds, after, tells


KINDS, AFTER, TELLS = _automaton()
#: By the two classes before a byte the state at it, whatever the state was before them.
_STATES = AFTER[AFTER[_FRESH]][:, np.arange(6)]
assert all((AFTER[AFTER[s]] == _STATES).all() for s in range(4)), "two bytes must fix the state"
#: What a byte tells, by its own class and the two before it; the transitions these stand for.
_TOLD = TELLS[_STATES].ravel()
_TRANSITIONS = (_STATES[:, :, None] * 6 + np.arange(6)).ravel()


def _steps(data: np.ndarray, start: int) -> np.ndarray:
    """For each byte of the block at ``start`` its class and the two before it as one number; a text begins as after line ends."""
    kinds = KINDS[data[max(0, start - 2) : start + BLOCK]]
    if start < 2:
        kinds = np.concatenate([np.full(2 - start, _NEWLINE, np.uint8), kinds])
    return kinds[:-2] * np.uint8(36) + kinds[1:-1] * np.uint8(6) + kinds[2:]


def scan(data: np.ndarray) -> np.ndarray:
    """Units, code points and sentinels of each block, from counts of its transitions."""
    counted = []
    for start in range(0, len(data), BLOCK):
        times = np.bincount(_TRANSITIONS, np.bincount(_steps(data, start), minlength=216), minlength=24).astype(np.int64)
        counted.append([times[(TELLS.ravel() & tell) > 0].sum() for tell in (UNIT, POINT, SENTINEL)])
    return np.array(counted, np.int64).reshape(-1, 3)


def cut(data: np.ndarray, counted: np.ndarray, units: int) -> tuple[int, int]:
    """Bytes and code points of the first ``units`` units."""
    upto = np.cumsum(counted, axis=0)
    if not units or units >= upto[-1, 0]:
        return (0, 0) if not units else (len(data), int(upto[-1, 1]))
    block = int(np.searchsorted(upto[:, 0], units, side="right"))
    before = upto[block - 1] if block else np.zeros(3, np.int64)
    told = _TOLD[_steps(data, block * BLOCK)]
    place = int(np.flatnonzero(told & UNIT)[units - before[0]])
    return block * BLOCK + place, int(before[1]) + int(np.count_nonzero(told[:place] & POINT))


def transform(data: bytes, draws: tuple[int, int, int, int], rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output for a UTF-8 text."""
    own = np.frombuffer(data, np.uint8)
    counted = scan(own)
    n, _, sentinels = counted.sum(axis=0).tolist()
    if not n or sentinels or draws[2] % 100 >= rate:
        return n, "plain", None, None, data
    (a, left), (b, right) = (cut(own, counted, k) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if draws[3] % 100 < spm:
        return n, "spm", left, right - left, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", left, right - left, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Four draws come from the hash of seed and id: two cuts, whether the text
    is transformed (``rate`` in 100), and whether suffix comes first (``spm`` in 100).
    """
    new = [T.StructField(name, kind()) for name, kind in (("n", T.LongType), ("form", T.StringType), ("prefix_chars", T.LongType), ("middle_chars", T.LongType), ("output", T.StringType))]
    kept = df.select(*(c for c in df.columns if c in (doc_id, text) or c not in {f.name for f in new}))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rest = kept.select(F.substring(drawn, 1, 32).alias("_drawn"), *kept.columns)
    at = rest.columns.index(text)
    # Where an id or text is named like a new column, the new one takes its place.
    stays = [k for k, c in enumerate(rest.columns) if k and c not in {f.name for f in new}]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for draw, value in zip(batch.column(0), batch.column(at)):
                hashed = draw.as_py()
                rows.append(transform((value.as_py() or "").encode(), tuple(int(hashed[k : k + 8], 16) for k in range(0, 32, 8)), rate, spm))
            found = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stays), *found], names=[*(batch.schema.names[k] for k in stays), *(f.name for f in new)])

    return rest.mapInArrow(moved, T.StructType([*(rest.schema.fields[k] for k in stays), *new]))


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output``: its parts between sentinels, in their first order."""
    at = {mark: F.locate(mark.decode(), output) for mark in (PREFIX, SUFFIX, MIDDLE)}
    middle = F.substring(output, at[MIDDLE] + 3, F.length(output))

    def between(mark: bytes, end: bytes) -> Column:
        return F.substring(output, at[mark] + 3, at[end] - at[mark] - 3)

    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
