"""BPE encoding with a priority queue over a doubly linked symbol list, and decoding by vocabulary strings.

A pre-token's symbols form a doubly linked list. The queue holds (rank, place) of every adjacent pair that can
merge; the least is taken, skipped if it is stale (its left symbol has gone, or the pair there has another rank
by now), else merged, and the two new neighbouring pairs enter the queue. Decoding joins the bytes of the ids
and reads them as UTF-8, with U+FFFD where they are not.

Nulls encode as empty texts (no ids, empty decoded text). Special strings inside a text become their own id, as
the library's default has it. Whole texts of any length; repeated rows encode alike; empty tables give empty
results; input columns beyond id and text are dropped, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import textio
from laurel.llm.vocabulary import vocabulary

#: Pre-tokens whose ids a worker remembers; beyond it the memory is emptied (it saves work, never drops rows).
REMEMBERED = 400_000
_PLACE = 32


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        right_ranks: list[dict[int, int]] = [{} for _ in range(self.vocabulary.size)]
        #: The id that the merge of each rank makes.
        self.made = []
        for rank, (a, b, made) in enumerate(self.vocabulary.merges):
            right_ranks[a].setdefault(b, rank)
            self.made.append(made)
        #: For each left id, the rank of its pair with a right id.
        self.rank_of = [ranks.get for ranks in right_ranks]
        self.known: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges; the given list is used up."""
        n, rank_of, made = len(symbols), self.rank_of, self.made
        queue = []
        for i in range(n - 1):
            rank = rank_of[symbols[i]](symbols[i + 1])
            if rank is not None:
                queue.append(rank << _PLACE | i)
        if not queue:
            return symbols
        heapify(queue)
        symbols.append(-1)  # the end, like a symbol that has gone
        after, before, place = list(range(1, n + 2)), list(range(-1, n)), (1 << _PLACE) - 1
        while queue:
            top = heappop(queue)
            i = top & place
            left, j, rank = symbols[i], after[i], top >> _PLACE
            right = symbols[j]
            if left < 0 or right < 0 or rank_of[left](right) != rank:
                continue
            new = made[rank]
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            before[k] = i
            beyond, h = symbols[k], before[i]
            if beyond >= 0:
                rank = rank_of[new](beyond)
                if rank is not None:
                    heappush(queue, rank << _PLACE | i)
            if h >= 0:
                rank = rank_of[symbols[h]](new)
                if rank is not None:
                    heappush(queue, rank << _PLACE | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces, marks = self.vocabulary.split(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        alphabet = self.vocabulary.bytes
        for piece in {p for p in pieces if p not in known}:
            known[piece] = np.array(self.merge([alphabet[b] for b in piece.encode()]), dtype="<u4").tobytes()
        out = list(map(known.__getitem__, pieces))
        for at, i in reversed(marks):
            out.insert(at, i.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        for part, _, _ in textio.slices(batches, "text"):
            ids = [of.encode(t) for t in part.column("text").fill_null("").to_pylist()]
            columns = [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([of.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"][: len(columns)])
        of.known.clear()  # a worker serves other tasks next
        textio.give_back()

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


def decode(encoded: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: id and the text of its ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        for batch in batches:
            texts = [of.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id].dataType.simpleString()
    return encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)
