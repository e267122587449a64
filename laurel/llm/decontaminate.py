"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows (13 consecutive words of an item; all words of a shorter item) are the patterns. Patterns
of one length share a shift table: the block of words that ends at a position tells how far the search may move
on, usually the whole window. Where the shift is zero, the suffix-hash bucket of the block selects patterns, whose
hashes and then bytes are compared directly. Texts are searched in lanes of positions side by side.

The patterns go to the executors as a broadcast of bounded size: as the driver reads the benchmark, every BLOCK_WINDOWS
windows make a block (some 60 bytes a window), and each block searches the documents by itself. With more than one block the documents are
first written with a number for each row; the blocks give only the rows they hit, which are united by that number. So every
row is judged as itself, whatever its id, and the number of blocks changes no result.

Nulls: a null text or item text has no words; a null item id is reported as the string "null"; a null document id is kept. Texts without words have no
hits and are never contaminated. Repeated rows, and rows that share an id, are judged each by its own text; equal item ids count as one item. Empty tables give
no hits. Input columns beyond id and text are dropped by `judge`; `clean` keeps all of them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.llm import shared, textio

WIDTH = 13
#: Words in a block of the shift table, and its least and greatest number of bits.
BLOCK_WORDS, TABLE_BITS = 3, (16, 26)
#: Positions that one lane searches.
LANE = 256
#: Benchmark windows in one broadcast.
BLOCK_WINDOWS = 1 << 20
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<first: long, last: long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def blocks_at(hashes: np.ndarray, last: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the blocks of words that end at the given positions."""
    out = np.zeros(len(last), dtype=np.uint64)
    for k in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[last - k]
    return textio.mix(out)


class Patterns:
    """The patterns of one length: windows of the words in `joined` (words of items, a space between), from `begin` to `end`, and the item (a place in `names`) of each."""

    def __init__(self, width: int, joined: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, first: np.ndarray, item: np.ndarray, names: list[str]):
        self.width, self.joined, self.names = width, joined, names
        self.block = min(BLOCK_WORDS, width)
        self.step = width - self.block + 1
        self.bits = int(np.clip(int(len(first) * self.step * 4).bit_length(), *TABLE_BITS))
        self.shift = np.full(1 << self.bits, self.step, dtype=np.uint8)
        for last in range(self.block - 1, width):
            slot = self.slot(blocks_at(hashes, first + last, self.block))
            np.minimum.at(self.shift, slot, np.uint8(width - 1 - last))
        suffix, whole = blocks_at(hashes, first + width - 1, self.block), blocks_at(hashes, first + width - 1, width)
        order = np.lexsort([item, whole, suffix])
        self.suffix, self.whole, self.item = suffix[order], whole[order], item[order]
        self.begin, self.end = begin[first][order], end[first + width - 1][order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, item) of all occurrences; `first` bounds the texts in the array of words."""
        begin, stop = first[:-1] + self.width - 1, first[1:]
        lanes = np.maximum(0, -(-(stop - begin) // LANE))
        text = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[text] + nth * LANE
        until = np.minimum(at + LANE, stop[text])
        zero = []
        while len(at):
            shift = self.shift[self.slot(blocks_at(hashes, at, self.block))]
            zero.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < until
            at, until = at[live], until[live]
        last = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        blocks = blocks_at(hashes, last, self.block)
        low, high = np.searchsorted(self.suffix, blocks), np.searchsorted(self.suffix, blocks, side="right")
        size = high - low
        last = np.repeat(last, size)
        pattern = np.repeat(low, size) + np.arange(len(last)) - np.repeat(np.cumsum(size) - size, size)
        same = blocks_at(hashes, last, self.width) == self.whole[pattern]
        last, pattern = last[same], pattern[same]
        sure = np.ones(len(last), bool)
        for i, (word, p) in enumerate(zip(last.tolist(), pattern.tolist(), strict=True)):
            a = word - self.width + 1
            sure[i] = b" ".join(buf[s:e].tobytes() for s, e in zip(starts[a : word + 1], ends[a : word + 1], strict=True)) == self.joined[self.begin[p] : self.end[p]]
        return last[sure], self.item[pattern[sure]]


def words_of(text: str) -> list[bytes]:
    buf = textio.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends, _ = textio.word_bounds(buf, np.array([0, len(buf)]), textio.ALNUM)
    return [buf[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


def compiled(items: list[tuple[str, list[bytes]]], width: int = WIDTH) -> list[Patterns]:
    """The patterns of (item id, words) rows, by length; items without words have none."""
    by_width: dict[int, list[tuple[str, list[bytes]]]] = {}
    for item, words in items:
        if words:
            by_width.setdefault(min(width, len(words)), []).append((item, words))
    out = []
    for size, rows in sorted(by_width.items()):
        names = sorted({item for item, _ in rows})
        place = {item: i for i, item in enumerate(names)}
        joined = b" ".join(w for _, words in rows for w in words)
        buf = np.frombuffer(joined, dtype=np.uint8)
        starts, ends, _ = textio.word_bounds(buf, np.array([0, len(buf)]), textio.NOT_SPACE)
        hashes = textio.word_hashes(buf, starts, ends)
        numbers = np.array([len(words) for _, words in rows])
        bases = np.cumsum(numbers) - numbers
        first = np.concatenate([np.arange(a, a + n - size + 1) for a, n in zip(bases, numbers, strict=True)])
        item = np.repeat(np.array([place[item] for item, _ in rows], dtype=np.int32), numbers - size + 1)
        _, once = np.unique(np.stack([blocks_at(hashes, first + size - 1, size), item.astype(np.uint64)]), axis=1, return_index=True)  # a window once an item
        out.append(Patterns(size, joined, starts, ends, hashes, first[once], item[once], names))
    return out


def blocks_of(items: Iterable[tuple[str, str | None]], windows: int, width: int = WIDTH) -> Iterator[list[Patterns]]:
    """Compiled blocks of at most `windows` windows; a longer item alone goes on in the next block, from its window after the last."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, text in items:
        words = words_of(text or "")
        many = max(1, len(words) - width + 1) if words else 0
        at = 0
        while at < many:
            took = min(many - at, windows - size)
            held.append((item, words[at : at + took + min(width, len(words)) - 1]))
            size, at = size + took, at + took
            if size == windows:
                yield compiled(held, width)
                held, size = [], 0
    if held:
        yield compiled(held, width)


def searched(docs: DataFrame, patterns: list[Patterns], text: str, hits_only: bool = False) -> DataFrame:
    """The structs `row` of `docs` with SCHEMA, from the field `text` of each; spans are first and last word of united occurrences, counted from 0."""
    held = docs.sparkSession.sparkContext.broadcast(patterns)
    place = next(i for i, f in enumerate(docs.schema["row"].dataType.fields) if f.name == text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), pc.struct_field(b.column("row"), [place])], ["row", "text"]) for b in batches)
        for part, buf, offsets in textio.slices(with_text, "text"):
            buf = textio.LOWER[buf]
            starts, ends, first = textio.word_bounds(buf, offsets, textio.ALNUM)
            hashes = textio.word_hashes(buf, starts, ends)
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            items: dict[int, set[str]] = {}
            for group in held.value:
                last, item = group.search(buf, starts, ends, first, hashes)
                np.add.at(edge, last - group.width + 1, 1)
                np.add.at(edge, last + 1, -1)
                for doc, i in zip((np.searchsorted(first, last, side="right") - 1).tolist(), item.tolist(), strict=True):
                    items.setdefault(doc, set()).add(group.names[i])
            hit = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            spans: list[list] = [[] for _ in range(len(part))]
            for doc in items:
                a, b = first[doc], first[doc + 1]
                change = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                spans[doc] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True)]
            found = pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    pa.array(np.diff(first)),
                    pa.array(total[first[1:]] - total[first[:-1]]),
                    pa.array([sorted(items.get(i, ())) for i in range(len(part))], pa.list_(pa.string())),
                    pa.array(spans, _SPANS),
                ],
                ["row", "n_words", "n_hit", "items", "spans"],
            )
            yield found.take(pa.array(sorted(items), pa.int64())) if hits_only else found
        textio.give_back()

    return docs.select("row").mapInArrow(run, T.StructType([docs.schema["row"], *T.StructType.fromDDL(SCHEMA)]))


def united(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The hits of several blocks (number, items, spans) on the numbered rows of `rows`, as if one search had made them."""
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    everything = everything.groupBy("number").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),  # as many lists as there are blocks
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
    )
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<first: bigint, last: bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["last"], x["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    everything = everything.select("number", F.col("items").alias("_items"), merged.alias("_spans"))
    n_hit = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<first: bigint, last: bigint>>")), F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    empty = F.array().cast("array<string>"), F.array().cast("array<struct<first: bigint, last: bigint>>")
    joined = rows.join(everything, rows["row.number"] == everything["number"], "left")
    return joined.select("row", "n_words", n_hit.alias("n_hit"), F.coalesce("_items", empty[0]).alias("items"), F.coalesce("_spans", empty[1]).alias("spans"))


def judged(docs: DataFrame, carried: Column, benchmark: DataFrame, text: str, item_id: str, item_text: str, block_windows: int) -> DataFrame:
    """`row` (the struct `carried` of each row of `docs`, with its field `text`), SCHEMA and contaminated."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    rows = docs.select(carried.alias("row"))
    blocks = blocks_of(((r.item, r.text) for r in items.toLocalIterator()), block_windows)
    one, more = next(blocks, []), next(blocks, None)
    if more is None:
        found = searched(rows, one, text)
    else:
        numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("number"), carried.alias("own"), carried[text].alias("text")).alias("row"))
        numbered = shared.written(numbered, "numbered")
        brief = numbered.select(F.struct("row.number", "row.text").alias("row"))
        parts = []
        for block in chain((one, more), blocks):
            hits = searched(brief, block, "text", hits_only=True).select("row.number", "items", "spans")
            parts.append(shared.written(hits, "hits", few_files=True))
        found = united(searched(numbered, [], "text"), parts).withColumn("row", F.col("row.own"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def judge(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row: id, n_words, n_hit (words inside an occurrence), items (ids as sorted strings), spans and contaminated (a twentieth of the words or more are hit)."""
    found = judged(docs, F.struct(F.col(id).alias("id"), F.col(text).alias("text")), benchmark, "text", item_id, item_text, block_windows)
    return found.select(F.col("row.id").alias(id), "n_words", "n_hit", "items", "spans", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns: each row passes through the search whole and stands or falls by its own text."""
    found = judged(docs, F.struct(*[F.col(c) for c in docs.columns]), benchmark, text, item_id, item_text, block_windows)
    return found.where("NOT contaminated").select("row.*")


#: The rule itself in SQL, over all windows of all texts.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM m),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM bi),
sizes AS (SELECT DISTINCT m FROM m),
di AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS x FROM di),
h AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.x = bw.x),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
