"""Token counts by byte-pair merging, without token ids.

A text is cut at the vocabulary's special strings, the rest into words by the
byte-level pattern. The symbols of a word are a linked list of its bytes; a
heap holds its adjacent pairs by rank and place. The lowest pair is popped and
merged until none is left, so a word's tokens are its bytes less its merges.

Every row is counted where it is read: nothing is shuffled. Memory grows
neither with the corpus nor, beyond the text itself, with a text: words come
in batches and the counts of short words are kept up to ``KNOWN`` of them.

Defined results: a null text is empty and has no bytes and no tokens; a
special string inside a text is one token; columns of ``df`` named like a new
one are replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The byte-level vocabularies' pattern of words, letters and digits to be filled in.
WORDS = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"
PLAIN = {"letter": r"\p{L}", "digit": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
#: Words whose counts a worker keeps, and the longest of them in code points.
KNOWN, SHORT = 1_000_000, 32
#: Code points above which a text's words are taken in batches of BATCH.
LONG, BATCH = 1 << 20, 1 << 16
_PLACE = (1 << 32) - 1
#: The symbol of a place that was merged into the one before it: no pair has it.
_GONE = 1 << 31


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    """Sorted code points as the ranges of a character class."""
    runs: list[list[int]] = []
    for point in points:
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Merges:
    """Ranked merges of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        before = held["pre_tokenizer"] or {}
        plain = held["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        same = not held["normalizer"] and not any(held["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or not same or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError(f"{path} isn't a plain byte-level byte-pair vocabulary")
        names = _byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        number = {name: k for k, name in enumerate(names)}
        for left, right in pairs:
            number.setdefault(left + right, len(number))
        #: By pair of symbols, ``left << 32 | right``: the merge's rank; by rank: the symbol it makes. Bytes are symbols 0 to 255.
        self.ranks = {number[left] << 32 | number[right]: rank for rank, (left, right) in enumerate(pairs)}
        self.made = [number[left + right] for left, right in pairs]
        special = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self._patterns(Tokenizer.from_file(path).pre_tokenizer)

    def _patterns(self, library) -> None:
        """The library's tables of letters and digits can be older than ours: ask it for each code point that only ours may know."""
        found = regex.findall(r"\p{L}|\p{N}", "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)))))
        newer = [("a" if regex.match(r"\p{L}", c) else "1") + c for c in found if unicodedata.category(c) == "Cn"]
        probe = "\n".join(newer)
        whole = {probe[a:b] for _, (a, b) in library.pre_tokenize_str(probe)}
        odd = [ord(word[1]) for word in newer if word not in whole]
        self.words = regex.compile(WORDS.format(**PLAIN))
        self.exact = self.doubtful = None
        if odd:
            listed = _ranges(odd)
            exact = {"letter": rf"[\p{{L}}--[{listed}]]", "digit": rf"[\p{{N}}--[{listed}]]", "other": rf"[[^\s\p{{L}}\p{{N}}]||[{listed}]]"}
            self.exact = regex.compile(WORDS.format(**exact))
            # All code points beyond the first plane take the exact pattern: a short class is searched fast.
            self.doubtful = re.compile(f"[{_ranges([c for c in odd if c < 0x10000])}\U00010000-\U0010ffff]")

    def of_bytes(self, word: bytes) -> int:
        """Symbols of ``word`` that are left when no pair can be merged."""
        symbols, rank_of, made = list(word), self.ranks.get, self.made
        count = end = len(symbols)
        heap = [rank << 32 | at for at in range(end - 1) if (rank := rank_of(symbols[at] << 32 | symbols[at + 1])) is not None]
        if not heap:
            return count
        heapify(heap)
        after, before = [*range(1, end + 1)], [*range(-1, end - 1)]
        while heap:
            lowest = heappop(heap)
            at, rank = lowest & _PLACE, lowest >> 32
            right = after[at]
            # A pair has a rank of its own: another rank, or none, means that a merge has changed this place.
            if right == end or rank_of(symbols[at] << 32 | symbols[right]) != rank:
                continue
            count -= 1
            new = symbols[at] = made[rank]
            symbols[right] = _GONE
            onward = after[at] = after[right]
            if onward != end:
                before[onward] = at
                if (rank := rank_of(new << 32 | symbols[onward])) is not None:
                    heappush(heap, rank << 32 | at)
            back = before[at]
            if back >= 0 and (rank := rank_of(symbols[back] << 32 | new)) is not None:
                heappush(heap, rank << 32 | back)
        return count

    def of_words(self, words: list[str]) -> int:
        known, total = self.known, 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.of_bytes(word.encode())
                if len(word) <= SHORT:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[word] = count
            total += count
        return total

    def of_text(self, text: str) -> int:
        """Tokens of a whole text; special strings count one."""
        cuts = [] if self.special is None else [m.span() for m in self.special.finditer(text)]
        total = len(cuts)
        for start, end in zip(chain([0], (b for _, b in cuts)), chain((a for a, _ in cuts), [len(text)])):
            part = text[start:end]
            pattern = self.exact if self.exact is not None and not part.isascii() and self.doubtful.search(part) else self.words
            if len(part) <= LONG:
                total += self.of_words(pattern.findall(part))
                continue
            found = (m.group() for m in pattern.finditer(part))
            while batch := list(islice(found, BATCH)):
                total += self.of_words(batch)
        return total


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The file's merges, read once in each worker."""
    return Merges(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each text."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    rest = df.select(*(c for c in df.columns if c == text or c not in {f.name for f in new}))
    at = rest.columns.index(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merges(path)
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(at):
                own = value.as_py() or ""
                sizes.append(len(own) if own.isascii() else len(own.encode()))
                tokens.append(counter.of_text(own))
            columns = [*batch.columns, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in new)])

    return rest.mapInArrow(counted, T.StructType([*rest.schema.fields, *new]))
