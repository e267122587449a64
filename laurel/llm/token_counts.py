"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of about a megabyte of text are held as one ragged numpy array of symbols. In every
round each sequence finds its lowest-ranked adjacent pair, all occurrences of that pair are merged at once (from
the left, without overlap), and only the pairs next to a merge look up a new rank. Sequences without a mergeable
pair leave; their surviving symbols are the count. A merged symbol takes part only in later merges, so this
gives the same symbols as merging one pair at a time.

Nulls count as empty texts (0 bytes, 0 tokens). Special strings inside a text count as one token each, as the
library's default has it. Texts are counted whole whatever their length; repeated rows get equal counts; empty
tables give empty results; input columns beyond id and text are dropped, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import textio
from laurel.llm.vocabulary import vocabulary

NO_RANK = np.int64(1 << 40)
#: Pre-tokens whose counts a worker remembers; beyond it the memory is emptied (it saves work, never drops rows).
REMEMBERED = 250_000


class PairTable:
    """Ranks of pairs of ids in open hash tables: pairs that collide in one level go to the next."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.size = size
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        self.made = made
        keys, ranks = left * size + right, np.arange(len(made), dtype=np.int64)
        _, once = np.unique(keys, return_index=True)
        keys, ranks = keys[once], ranks[once]
        self.levels = []
        while len(keys):
            slots = self._slot(keys, len(self.levels))
            held, rank = np.full(1 << 18, -1, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
            _, first = np.unique(slots, return_index=True)
            held[slots[first]], rank[slots[first]] = keys[first], ranks[first]
            self.levels.append((held, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]

    @staticmethod
    def _slot(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * level & (1 << 64) - 1)) >> np.uint64(46)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        out = np.full(len(keys), NO_RANK)
        for level, (held, rank) in enumerate(self.levels):
            slots = self._slot(keys, level)
            hit = held[slots] == keys
            out[hit] = rank[slots[hit]]
        return out


def merged_counts(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Surviving symbols of each sequence; `symbols` holds the sequences one after the other."""
    counts = lengths.astype(np.int64).copy()
    names = np.flatnonzero(lengths > 1)
    symbols = symbols[np.repeat(lengths > 1, lengths)].astype(np.int64)
    lengths = lengths[names].astype(np.int64)
    owner = np.repeat(np.arange(len(names)), lengths)

    def pair_ranks(at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the given places; the last symbol of a sequence begins none."""
        out = np.full(len(at), NO_RANK)
        ok = at + 1 < len(symbols)
        ok[ok] = owner[at[ok]] == owner[at[ok] + 1]
        out[ok] = table.ranks(symbols[at[ok]], symbols[at[ok] + 1])
        return out

    rank = pair_ranks(np.arange(len(symbols)))
    while len(names):
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(rank, starts)
        live = least < NO_RANK
        if not live.all():
            counts[names[~live]] = lengths[~live]
            kept = np.repeat(live, lengths)
            symbols, rank = symbols[kept], rank[kept]
            names, lengths, least = names[live], lengths[live], least[live]
            owner = np.repeat(np.arange(len(names)), lengths)
            if not len(names):
                break
        chosen = np.flatnonzero(rank == least[owner])
        # Overlapping occurrences stand side by side (a pair of equal symbols): every second one of a run merges.
        fresh = np.ones(len(chosen), bool)
        fresh[1:] = chosen[1:] != chosen[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
        chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
        symbols[chosen] = table.made[rank[chosen]]
        lengths = lengths - np.bincount(owner[chosen], minlength=len(names))
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        now = chosen - np.arange(len(chosen))
        symbols, owner, rank = symbols[stays], owner[stays], rank[stays]
        rank[now] = pair_ranks(now)
        before = now[now > 0] - 1
        rank[before] = pair_ranks(before)
    return counts


class Counter:
    """Counts tokens of many texts at a time."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.table = PairTable(self.vocabulary.merges, self.vocabulary.size)
        self.bytes = np.array(self.vocabulary.bytes, dtype=np.int64)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split = [self.vocabulary.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [p for p in set().union(*(p for p, _ in split)) if p not in known]
        if new:
            raw = [x.encode() for x in new]
            symbols = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            found = merged_counts(symbols, np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)), self.table)
            self.known.update(zip(new, found.tolist(), strict=True))
        of = self.known.__getitem__
        return [sum(map(of, pieces)) + len(marks) for pieces, marks in split]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8) and n_tokens of the whole text under the byte-level BPE file `tokenizer` (a path on every executor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for part, _, offsets in textio.slices(batches, "text"):
            texts = part.column("text").fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])
        counter(tokenizer).known.clear()  # a worker serves other tasks next

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id)
