"""Best-fit packing of token sequences by a grouping genetic algorithm.

Tokenizing runs in Spark tasks on whole texts. Documents longer than a
sequence are cut into full pieces; those fill a sequence each. The remaining
pieces are dealt to groups of about ``GROUP_ITEMS``; each group is packed by
``ISLANDS`` populations that evolve in separate tasks. A packing's genes are
its sequences: crossover injects whole well-filled sequences of one parent
into the other, removes sequences that hold the same pieces, and puts the
displaced pieces back by best fit, longest first; mutation dissolves the worst
filled. After each of ``EPOCHS`` the best packing of an island migrates to the
next one. A group that reaches its lower bound stops evolving.

Defined results: a null text is empty, and an empty one is the end token
alone; rows of equal id are documents of their own; no rows, no sequences.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.storage import keep

LENGTH = 2048
GROUP_ITEMS = 4096
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 4, 2, 4
SEED = 7
#: Words of which a task remembers the ids.
REMEMBERED = 1_200_000
END = b"\0\0\0\0"
#: Python's split() breaks at these, the tokenizer doesn't.
UNLIKE_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


class _Words(dict):
    """Ids of a word, as bytes; the tokenizer never joins what white space parts.

    A word of letters that punctuation follows has the ids of both after each
    other, and its first letter's case is ignored: only stems are encoded.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.stems: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def stem(self, word: str) -> bytes:
        found = self.stems.get(word)
        if found is None:
            if len(self.stems) >= REMEMBERED:
                self.stems.clear()
            found = self.stems[word] = self.ids(word)
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.clear()
        letters = word.rstrip(".,;:!?")
        if letters.isalpha() and is_normalized("NFC", letters):
            found = self.stem(letters[0].lower() + letters[1:])
            if len(letters) < len(word):
                found += self.stem(word[len(letters) :])
        else:
            found = self.ids(word)
        self[word] = found
        return found

    def document(self, text: str) -> bytes:
        if any(c in text for c in UNLIKE_SPACE):
            return self.ids(text) + END
        return b"".join(map(self.__getitem__, text.split())) + END


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    """One memory of words for all tasks of a Python worker."""
    return _Words(path)


def tokenized(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            at, out = [], []
            for k, own in enumerate(batch.column(1).to_pylist()):
                ids = words.document(own or "")
                for piece, start in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[start : start + 4 * length]
                    at.append(k)
                    out.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 4
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Which sequence each piece is in, and how much each sequence has left."""

    def __init__(self, sizes: list[int], length: int, held: list[int] | None = None):
        self.sizes, self.length = sizes, length
        self.held = [-1] * len(sizes) if held is None else list(held)
        self.bins: dict[int, list[int]] = {}
        for item, at in enumerate(self.held):
            if at >= 0:
                self.bins.setdefault(at, []).append(item)
        self.fresh = max(self.bins, default=-1) + 1
        self.left = {at: length - sum(sizes[i] for i in items) for at, items in self.bins.items()}
        self.by_left: dict[int, list[int]] = {}
        for at, left in self.left.items():
            self.by_left.setdefault(left, []).append(at)
        self.mask = sum(1 << left for left in self.by_left)

    def _move(self, at: int, left: int | None) -> None:
        old = self.left.pop(at, None)
        if old is not None:
            self.by_left[old].remove(at)
            if not self.by_left[old]:
                self.mask &= ~(1 << old)
        if left is not None:
            self.left[at] = left
            self.by_left.setdefault(left, []).append(at)
            self.mask |= 1 << left

    def add(self, items: list[int]) -> None:
        """Best fit, longest first: the fullest sequence with room for each."""
        for item in sorted(items, key=lambda i: (-self.sizes[i], i)):
            self.fit(item)

    def fit(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = self.by_left[left][-1]
        else:
            left, at = self.length, self.fresh
            self.fresh += 1
            self.bins[at] = []
        self.bins[at].append(item)
        self.held[item] = at
        self._move(at, left - size)

    def remove(self, at: int) -> list[int]:
        items = self.bins.pop(at)
        for item in items:
            self.held[item] = -1
        self._move(at, None)
        return items

    def inject(self, groups: list[list[int]]) -> None:
        """Take over whole sequences; those that hold one of their pieces go, and the rest of these is put back."""
        taken = {item for items in groups for item in items}
        loose: list[int] = []
        for at in {self.held[item] for item in taken}:
            loose += [item for item in self.remove(at) if item not in taken]
        for items in groups:
            at, self.fresh = self.fresh, self.fresh + 1
            self.bins[at] = list(items)
            for item in items:
                self.held[item] = at
            self._move(at, self.length - sum(self.sizes[i] for i in items))
        self.add(loose)

    def dissolve(self, share: float) -> None:
        worst = sorted(self.left, key=lambda at: (-self.left[at], at))[: max(2, int(len(self.left) * share))]
        self.add([item for at in worst for item in self.remove(at)])

    def fitness(self) -> tuple[int, float]:
        """Fewer sequences first, then fuller ones beside emptier ones."""
        return -len(self.bins), sum((self.length - left) ** 2 for left in self.left.values())

    def numbers(self) -> np.ndarray:
        return np.unique(np.array(self.held, dtype=np.int64), return_inverse=True)[1].astype("<i4") if self.held else np.empty(0, "<i4")


def evolve(sizes: list[int], population: list[list[int]], rng: random.Random, length: int, generations: int) -> list[Packing]:
    """Packings after some generations, the fittest first."""
    people = [Packing(sizes, length, held) for held in population]
    while len(people) < POPULATION:
        person = Packing(sizes, length)
        if not people:
            person.add(list(range(len(sizes))))
        else:
            for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i] // rng.choice((1, 64, 256)), rng.random())):
                person.fit(item)
        people.append(person)
    people.sort(key=Packing.fitness, reverse=True)
    bound = -(-sum(sizes) // length)
    for _ in range(generations):
        if len(people[0].bins) <= bound:
            break
        children = []
        for _ in range(POPULATION // 2):
            one, other = rng.sample(people, 2)
            full = sorted(other.left, key=lambda at: (other.left[at], at))
            full = full[: max(1, len(full) // 2)]
            genes = [other.bins[at] for at in rng.sample(full, max(1, len(full) // 2))]
            child = Packing(sizes, length, one.held)
            child.inject(genes)
            child.dissolve(0.02)
            children.append(child)
        people = sorted([*people, *children], key=Packing.fitness, reverse=True)[:POPULATION]
    return people


def pack(pieces: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``length``."""
    spark = pieces.sparkSession
    rows = keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = rows.where(F.col("length") < length)
    groups = max(1, round(part.count() / GROUP_ITEMS))
    grouped = part.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int"))
    order = ["length", "_row"]

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame.sort_values(order)["length"].to_numpy(dtype="<i4").tobytes()
        n = frame["_group"].iloc[0]
        return pd.DataFrame({"_group": [n] * ISLANDS, "island": range(ISLANDS), "sizes": [sizes] * ISLANDS, "people": [[]] * ISLANDS, "bins": [1 << 30] * ISLANDS})

    def advance(epoch: int):
        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    sizes = np.frombuffer(row.sizes, dtype="<i4").tolist()
                    rng = random.Random(f"{SEED}/{epoch}/{row._asdict().get('_group', row[0])}/{row.island}")
                    people = evolve(sizes, [np.frombuffer(p, dtype="<i4").tolist() for p in row.people], rng, length, GENERATIONS)
                    out.append((row[0], row.island, row.sizes, [p.numbers().tobytes() for p in people], len(people[0].bins)))
                yield pd.DataFrame(out, columns=["_group", "island", "sizes", "people", "bins"])

        return step

    state = "_group int, island int, sizes binary, people array<binary>, bins int"
    now = keep(grouped.select("_group", "length", "_row").groupBy("_group").applyInPandas(settle, state), "islands")
    for epoch in range(EPOCHS):
        now = keep(now.repartition(-(-groups * ISLANDS // 4), "_group", "island").mapInPandas(advance(epoch), state), "islands")
        if epoch + 1 < EPOCHS:
            ring = Window.partitionBy("_group").orderBy("island")
            guest = F.coalesce(F.lag(F.element_at("people", 1)).over(ring), F.last(F.element_at("people", 1)).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            now = now.withColumn("people", F.concat(F.slice("people", 1, POPULATION - 1), F.array(guest)))
    best = now.groupBy("_group").agg(F.min_by(F.element_at("people", 1), F.struct("bins", "island")).alias("held"))

    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(order).reset_index(drop=True)
        items["held"] = np.frombuffer(chosen["held"].iloc[0], dtype="<i4")
        items["offset"] = items.groupby("held")["length"].cumsum() - items["length"]
        items["sequence_id"] = items["held"].astype("int64") * groups + items["_group"]
        return items[[*columns, "sequence_id", "offset"]]

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    named = grouped.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = named.groupBy("_group").cogroup(best.groupBy("_group")).applyInPandas(assign, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    full = rows.where(F.col("length") >= length).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
