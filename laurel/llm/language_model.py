"""Scoring texts by a gated recurrent language model with a class-factored softmax, in numpy.

Counts: every training text is counted whole. Words within the FREQUENT most frequent ones travel as a broadcast of
bounded size; all others meet their counts in a join, so nothing that grows with the corpus is broadcast.

Model: a gated recurrent unit reads symbols. The most frequent words are symbols of their own, in classes of like shares; every other
word, however rare and also one never seen, belongs by its spelling (from the last letter back) to one of the tail classes, whose bounds give
them like shares of the counts. The softmax is factored: first the class, then the word within it, by a softmax of its own in the former classes and by the words' counts over those of their class
in the latter. So the model is a distribution over all words of the counts and, in each tail class, one unseen word. The numbers of both
kinds of classes follow from the number of distinct words (`Shape`), the size of the state is a parameter.

Every text is encoded once, as the symbols of its tokens in 16 bits; training and scoring read these.

Training: truncated backpropagation over windows of STEPS tokens or more on lanes of concatenated texts; the state is carried from
window to window through a whole text and cleared where a text begins. Training texts are dealt by hash to shards of about SHARD tokens and sorted, so that
scores depend neither on the partitions nor on the order of the input, and a lost task trains the same again. In each round the shards train on their own rows of that round from a common
start, and their parameters are averaged by tokens; the rounds together read every training text once.

Scoring: all tokens of a text, the state carried across windows, give its complete log-likelihood.

Nulls are empty texts (one end token). Without training texts the score is the base score. Repeated rows are scored
alike. Texts of any length are read whole; long ones occupy one lane. Empty tables give empty results. Input columns
beyond id and text are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.llm import shared, textio

#: Words whose counts are broadcast, at most.
FREQUENT = 1 << 18
#: Units of the state, words of a class that has a softmax of its own, and the least and greatest number of tail classes.
HIDDEN, PER_CLASS, TAILS = 16, 32, (64, 96)
#: Tokens that a window takes back at least, lanes at most, and tokens of a window when few lanes are left.
STEPS, LANES, WINDOW = 16, 256, 4096
#: Tokens of a training shard, shards at most (beyond, shards grow), sixteenths of the training texts after which parameters are averaged, and the steps of Adam in each round.
SHARD, SHARDS, ROUNDS, RATES = 1 << 21, 4096, (1, 6, 16), (0.02, 0.01, 0.005)
#: Tokens that a task holds at a time (a longer text is held whole).
HELD = 1 << 22
#: Words that a task counts before it hands them on.
COUNTED = 500_000
#: Tasks that average parameters, and parameters in a slice; the slices of one model reach the driver.
AVERAGERS, SLICE = 16, 1 << 14
END = b""


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


# Counts.


def counted(docs: DataFrame) -> DataFrame:
    """w (a lower-cased word, or END) and n over all rows of `docs` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            for text in batch.column("text"):
                found.update(words_of(text.as_py()))
                found[END] += 1
                if len(found) > COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Shape:
    """Units of the state, classes of PER_CLASS words with a softmax of their own, and tail classes by spelling."""

    hidden: int
    classes: int
    tails: int

    @property
    def heads(self) -> int:
        return self.classes * PER_CLASS

    @property
    def symbols(self) -> int:
        return self.heads + self.tails


def shape_of(distinct: int, hidden: int = HIDDEN) -> Shape:
    """The distinct words to the power of 0.4, within bounds, are tail classes; a fourth as many classes of PER_CLASS words have softmaxes of their own."""
    tails = int(np.clip(round(distinct**0.4), *TAILS))
    return Shape(hidden, max(16, tails // 4), tails)


@dataclass
class Vocabulary:
    """Counts of the frequent words, the bounds of the tail classes and what the counts of each have together, and the totals N and V."""

    index: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    shape: Shape
    bounds: list[bytes]
    masses: np.ndarray

    @property
    def below(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def end(self) -> int:
        return self.index[END]

    def symbol_of_rare(self, word: bytes) -> int:
        return self.shape.heads + bisect_right(self.bounds, word[::-1])

    def symbols(self) -> np.ndarray:
        """The symbol of every frequent word."""
        out = np.arange(len(self.counts), dtype=np.int32)
        for word, k in self.index.items():
            if k >= self.shape.heads:
                out[k] = self.symbol_of_rare(word)
        return out

    def log_masses(self) -> np.ndarray:
        """log10 of what each symbol's words have together; a word with a symbol of its own needs no share, so that is 0."""
        return np.concatenate([np.zeros(self.shape.heads), np.log10(self.masses)])


def bounds_of(words: list[bytes], weights: np.ndarray, tails: int) -> list[bytes]:
    """The reversed words that begin a new tail class, so that the classes have like weights."""
    if not words:
        return []
    order = sorted(range(len(words)), key=lambda i: words[i][::-1])
    share = np.cumsum(weights[order])
    cuts = np.searchsorted(share, share[-1] * np.arange(1, tails) / tails)
    return sorted({words[order[i]][::-1] for i in np.minimum(cuts, len(order) - 1).tolist()})


def vocabulary(counts: DataFrame, hidden: int = HIDDEN) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    # The least count of which all words fit, from the number of words of each count up to a bound.
    large = counts.select(F.least("n", F.lit(1 << 14)).alias("n")).groupBy("n").count().orderBy(F.desc("n")).collect()  # at most 16,384 rows
    held, least = 0, (1 << 14) + 1
    for row in large:
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["n"]
    found = counts.where((F.col("n") >= least) | (F.col("w") == F.lit(bytearray(END)))).toArrow()  # at most FREQUENT + 1 rows
    words, numbers = found.column("w").to_pylist(), found.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -numbers[i], words[i]))
    words, numbers = [words[i] for i in order], np.array([numbers[i] for i in order], dtype=np.int64)
    shape = shape_of(distinct, hidden)
    bounds = bounds_of(words[shape.heads :], numbers[shape.heads :] + 0.5, shape.tails)
    shape = Shape(shape.hidden, shape.classes, len(bounds) + 1)
    own = set(words[: shape.heads])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(bounds) + 1)
        for batch in batches:
            ns = batch.column("n").to_numpy()
            places = [bisect_right(bounds, w[::-1]) if w not in own else -1 for w in batch.column("w").to_pylist()]
            places = np.array(places, dtype=np.int64)
            sums += np.bincount(places[places >= 0], weights=ns[places >= 0] + 0.5, minlength=len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["k", "m"])

    weighed = counts.select("w", "n").mapInArrow(weigh, "k long, m double").groupBy("k").agg(F.sum("m").alias("m")).collect()  # as many rows as tail classes
    masses = np.full(shape.tails, 0.5)
    for row in weighed:
        masses[row.k] += row.m
    return Vocabulary({w: k for k, w in enumerate(words)}, numbers, total or 0, distinct, shape, bounds, masses)


# The network.


def shapes(of: Shape) -> dict[str, tuple[int, ...]]:
    return {
        "into": (of.symbols, 3 * of.hidden),
        "gate": (of.hidden, 3 * of.hidden),
        "class": (of.hidden, of.classes + of.tails),
        "class_bias": (of.classes + of.tails,),
        "word": (of.classes, of.hidden, PER_CLASS),
        "word_bias": (of.classes, PER_CLASS),
    }


def started(of: Shape, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters to start from."""
    draw = np.random.default_rng(seed)
    scale = {"into": 0.1, "gate": 1 / np.sqrt(of.hidden), "class": 0.1, "word": 0.1}
    return {k: (draw.standard_normal(n) * scale[k]).astype(np.float32) if k in scale else np.zeros(n, np.float32) for k, n in shapes(of).items()}


def with_shares(p: dict[str, np.ndarray], of: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters whose biases give each symbol its share of the counts, so that training starts from the base model."""
    mass = np.full(of.shape.heads, 1e-6 * of.below)  # symbols that no word has
    n = min(len(of.counts), of.shape.heads)
    mass[:n] = of.counts[:n] + 0.5
    c, w = np.arange(of.shape.heads) % of.shape.classes, np.arange(of.shape.heads) // of.shape.classes
    classes = np.bincount(c, weights=mass)
    p["word_bias"][c, w] = np.log(mass / classes[c])
    every = np.concatenate([classes, of.masses])
    p["class_bias"][:] = np.log(every / every.sum())
    return p


def packed(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[k].ravel() for k in sorted(parameters)])


def unpacked(flat: np.ndarray, of: Shape) -> dict[str, np.ndarray]:
    out, at, found = {}, 0, shapes(of)
    for k in sorted(found):
        size = int(np.prod(found[k]))
        out[k] = flat[at : at + size].reshape(found[k]).astype(np.float32)
        at += size
    return out


def class_of(p: dict[str, np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in it: neighbours in rank go to different classes, so that classes have like shares; a tail symbol is a class."""
    classes, _, size = p["word"].shape
    own = symbols < classes * size
    return np.where(own, symbols % classes, symbols - classes * size + classes), np.where(own, symbols // classes, 0)


def states(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The states after each step of a window; x and first (whether a text begins) are steps by lanes. `keep` receives what backward() needs."""
    size, (steps, lanes) = p["gate"].shape[0], x.shape
    gate, rows = p["gate"].copy(), p["into"][x]
    gate[:, : 2 * size] *= 0.5  # the logistic function of v is tanh(v / 2) / 2 + 1 / 2
    rows[:, :, : 2 * size] *= 0.5
    out = np.empty((steps, lanes, size), np.float32)
    held = steps if keep is not None else 1
    gates, new, turn, before = (np.empty((held, lanes, k * size), np.float32) for k in (2, 1, 3, 1))
    begins = first.any(axis=1).tolist()
    for t in range(steps):
        if begins[t]:
            h = h * ~first[t][:, None]
        k = t % held
        g, n, o = gates[k], new[k], out[t]
        v = np.matmul(h, gate, out=turn[k])
        np.add(rows[t, :, : 2 * size], v[:, : 2 * size], out=g)
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.multiply(g[:, size:], v[:, 2 * size :], out=n)
        n += rows[t, :, 2 * size :]
        np.tanh(n, out=n)
        if keep is not None:
            before[k] = h
        np.subtract(h, n, out=o)
        o *= g[:, :size]
        o += n
        h = o
    if keep is not None:
        keep.update(gates=gates, new=new, turn=turn[:, :, 2 * size :], before=before)
    return out


def log_share(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-softmax of each row's target, and the rows' exponentials with their sums."""
    np.clip(logits, -40, 40, out=logits)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], np.float32)
    return own - np.log(sums), logits, sums


def outputs(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, gradients: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each symbol y after state h; with `gradients`, also adds those of the loss and returns that of h."""
    many, _, size = p["word"].shape
    c, w = class_of(p, y)
    order = np.argsort(c.astype(np.int16), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(many + 1)).tolist()
    own = bounds[-1]  # rows whose class has a softmax come first
    h, c, w, rows = h[order], c[order], w[order][:own], np.arange(len(y))
    class_logs, classes, class_sums = log_share(h @ p["class"] + p["class_bias"], c)
    logits = np.empty((own, size), np.float32)
    pieces = [(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    for k, a, b in pieces:
        np.matmul(h[a:b], p["word"][k], out=logits[a:b])
        logits[a:b] += p["word_bias"][k]
    word_logs, words, word_sums = log_share(logits, w)
    class_logs[:own] += word_logs
    logs = np.empty(len(y), np.float32)
    logs[order] = class_logs
    if gradients is None:
        return logs, None
    classes /= class_sums[:, None]
    classes[rows, c] -= 1
    words /= word_sums[:, None]
    words[rows[:own], w] -= 1
    gradients["class"] += h.T @ classes
    gradients["class_bias"] += classes.sum(axis=0)
    through = classes @ p["class"].T
    for k, a, b in pieces:
        gradients["word"][k] += h[a:b].T @ words[a:b]
        gradients["word_bias"][k] += words[a:b].sum(axis=0)
        through[a:b] += words[a:b] @ p["word"][k].T
    back = np.empty_like(through)
    back[order] = through
    return logs, back


def backward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, kept: dict, back: np.ndarray, gradients: dict) -> None:
    """Gradients of a window, back to its first step; that of "into" as (rows, their gradients), since a window reads few symbols."""
    size, (steps, lanes) = p["gate"].shape[0], x.shape
    z, r, new, before = kept["gates"][:, :, :size], kept["gates"][:, :, size:], kept["new"], kept["before"]
    # Derivatives that do not depend on the steps after, for the whole window.
    by_z, by_new, by_r = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), kept["turn"] * r * (1 - r)
    through, inner = np.empty((steps, lanes, 3 * size), np.float32), np.empty((steps, lanes, size), np.float32)
    begins, gate = first.any(axis=1).tolist(), np.ascontiguousarray(p["gate"].T)
    carry = np.zeros((lanes, size), np.float32)
    for t in range(steps - 1, -1, -1):
        carry += back[t]
        step, n = through[t], inner[t]
        np.multiply(carry, by_z[t], out=step[:, :size])
        np.multiply(carry, by_new[t], out=n)
        np.multiply(n, by_r[t], out=step[:, size : 2 * size])
        np.multiply(n, r[t], out=step[:, 2 * size :])
        carry *= z[t]
        carry += step @ gate
        if begins[t]:
            carry *= ~first[t][:, None]
    gradients["gate"] += before.reshape(-1, size).T @ through.reshape(-1, 3 * size)
    through[:, :, 2 * size :] = inner
    ids = x.ravel()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    gradients["into"] = ids[starts], np.add.reduceat(through.reshape(-1, 3 * size)[order], starts, axis=0)


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}
        self.n = 0

    def step(self, p: dict[str, np.ndarray], gradients: dict, rate: float) -> None:
        """Gradients are whole or (rows, their gradients); rows that are not there stay as they are."""
        self.n += 1
        rate *= np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        for k, g in gradients.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.first[k][rows], self.second[k][rows]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            self.first[k][rows], self.second[k][rows] = m, v
            p[k][rows] -= np.float32(rate) * m / (np.sqrt(v) + 1e-6)


# Texts in lanes.


def laid(symbols: np.ndarray, bounds: np.ndarray, lanes: int) -> list[np.ndarray]:
    """The texts of each lane, longest first to the lane with the least tokens, lanes by falling length."""
    sizes = np.diff(bounds)
    queue = [(0, k) for k in range(min(lanes, len(sizes)))]
    heapify(queue)
    held: list[list[int]] = [[] for _ in queue]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = queue[0]
        held[k].append(i)
        heapreplace(queue, (size + int(sizes[i]), k))
    return sorted((np.array(x, dtype=np.int64) for x in held), key=lambda x: -int(sizes[x].sum()))


def windows(symbols: np.ndarray, bounds: np.ndarray, lanes: int, steps: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(input symbols, whether a text begins, which are there, their places in `symbols`): steps by lanes; lanes leave at the right as they end, and windows get longer then."""
    held = laid(symbols, bounds, lanes)
    order = np.concatenate([np.arange(bounds[i], bounds[i + 1], dtype=np.int32) for x in held for i in x])
    sizes = np.diff(bounds)
    length = np.array([int(sizes[x].sum()) for x in held])
    start = np.cumsum(length) - length
    begins = np.zeros(len(symbols), bool)
    begins[bounds[:-1]] = True
    begins = begins[order]
    before = np.empty_like(symbols)
    before[1:] = symbols[order[:-1]]
    before[begins] = end
    at = 0
    while at < length[0]:
        live = int((length > at).sum())  # lanes are sorted by length
        step = np.arange(at, min(at + max(steps, min(WINDOW // live, 16 * steps)), int(length[0])))[:, None]
        there = step < length[:live]
        place = np.where(there, start[:live] + step, 0)
        yield before[place], begins[place] & there, there, order[place[there]]
        at += len(step)


def trained_on(p: dict[str, np.ndarray], adam: Adam, symbols: np.ndarray, bounds: np.ndarray, rate: float, end: int = 0) -> None:
    """One pass over whole texts."""
    lanes = int(np.clip(len(symbols) // 200, 1, LANES))
    h = np.zeros((lanes, p["gate"].shape[0]), np.float32)
    for x, first, there, place in windows(symbols, bounds, lanes, STEPS, end):
        kept: dict = {}
        gradients: dict = {k: np.zeros_like(v) for k, v in p.items() if k != "into"}
        out = states(p, x, first, h[: x.shape[1]], kept)
        whole = there.all()
        _, back = outputs(p, out.reshape(-1, out.shape[2]) if whole else out[there], symbols[place], gradients)
        full = back.reshape(out.shape) if whole else np.zeros_like(out)
        if not whole:
            full[there] = back
        backward(p, x, first, kept, full, gradients)
        n = np.float32(max(1, len(place)))
        adam.step(p, {k: (g[0], g[1] / n) if k == "into" else g / n for k, g in gradients.items()}, rate)
        h = out[-1]


def scored_on(p: dict[str, np.ndarray], symbols: np.ndarray, bounds: np.ndarray, end: int = 0) -> np.ndarray:
    """Log10-probability of the symbols of each whole text."""
    logs = np.zeros(len(symbols))
    lanes = int(np.clip(len(symbols) // 200, 1, LANES))
    h = np.zeros((lanes, p["gate"].shape[0]), np.float32)
    for x, first, there, place in windows(symbols, bounds, lanes, STEPS, end):
        out = states(p, x, first, h[: x.shape[1]])
        logs[place] = outputs(p, out[there], symbols[place])[0]
        h = out[-1]
    return np.add.reduceat(logs, bounds[:-1]) / np.log(10)


# Over the corpus.


def encoded(docs: DataFrame, words) -> DataFrame:
    """`docs` (id, text, h, training) as id, row (a number of its own), h, training, n_tokens, known (of them among the frequent words), base (what these give to the base score),
    shares (the logarithms of the shares of tail words in their class, without the counts of rare words), symbols (16 bits each) and rare (words that are not frequent, with their numbers)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["id"].dataType
    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("row long, h long, training boolean, n_tokens long, known long, base double, shares double, symbols binary, rare array<struct<w: binary, n: bigint>>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Vocabulary = words.value
        get, end, missing, rare_symbol, heads = of.index.get, np.array([of.end], dtype=np.int32), repeat(-1), of.symbol_of_rare, of.shape.heads
        table, masses = np.append(of.symbols(), -1).astype(np.int16), of.log_masses()
        logs = np.append(np.log10(of.counts + 0.5), 0.0)  # the last is for rare words, which the join adds
        less, row = np.log10(of.below), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, buf, offsets in textio.slices([batch], "text", 4 * textio.SLICE_BYTES):
                data = buf.tobytes()
                numbers, counted, flat_rare, sizes = [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = data[a:b].lower().split()
                    found = np.fromiter(map(get, own, missing), dtype=np.int32, count=len(own))
                    rare = [own[k] for k in np.flatnonzero(found < 0).tolist()]
                    numbers += (found, end)
                    sizes.append(len(own) + 1)
                    flat_rare += rare
                    counted.append(Counter(rare))
                flat, bounds = np.concatenate(numbers), np.concatenate([[0], np.cumsum(sizes)])
                symbols = table[flat]
                symbols[flat < 0] = np.fromiter(map(rare_symbol, flat_rare), dtype=np.int16, count=len(flat_rare))
                log = logs[flat]
                shares = np.where(symbols >= heads, log, 0.0) - masses[symbols]
                pairs = pa.StructArray.from_arrays([pa.array([w for x in counted for w in x], pa.binary()), pa.array([n for x in counted for n in x.values()], pa.int64())], ["w", "n"])
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").cast(id_type),
                        pa.array(np.arange(row, row + n)),
                        part.column("h"),
                        part.column("training"),
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat((flat >= 0).astype(np.int64), bounds[:-1])),
                        pa.array(np.add.reduceat(log, bounds[:-1]) - np.diff(bounds) * less),
                        pa.array(np.add.reduceat(shares, bounds[:-1])),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(symbols)]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in counted])]), pa.int32()), pairs),
                    ],
                    schema.names,
                )
                row += n

    return docs.select("id", "text", "h", "training").mapInArrow(run, schema)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their symbols one text after the other, bounds) of at most HELD tokens, or of one longer text."""
    for part, raw, offsets in textio.slices(batches, "symbols", 2 * HELD):
        if len(part):
            yield part, raw.view(np.int16), offsets // 2


def begun(of: Vocabulary) -> np.ndarray:
    """The parameters that training starts from."""
    return packed(with_shares(started(of.shape), of))


def averaged(learnt: DataFrame, words, model: np.ndarray, rate: float) -> np.ndarray:
    """The parameters after every partition of `learnt` (h, symbols), a shard, went on from `model` on its own rows, averaged by tokens."""
    begin = learnt.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textio.one_thread()
        p, tokens, shard = unpacked(begin.value, words.value.shape), 0, TaskContext.get().partitionId()
        adam = Adam(p)
        for _, symbols, bounds in groups_of(batches):
            trained_on(p, adam, symbols, bounds, rate, words.value.end)
            tokens += len(symbols)
        if tokens:
            flat = packed(p)
            for k, at in enumerate(range(0, len(flat), SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([flat[at : at + SLICE].tobytes()], pa.binary()), pa.array([tokens], pa.int64()), pa.array([k], pa.int64()), pa.array([shard], pa.int64())], ["p", "n", "k", "shard"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        tokens: Counter[int] = Counter()
        for batch in batches:
            for p, n, k in zip(batch.column("p"), batch.column("n").to_pylist(), batch.column("k").to_pylist(), strict=True):
                own = n * np.frombuffer(p.as_py(), dtype=np.float32).astype(np.float64)
                total[k] = total[k] + own if k in total else own
                tokens[k] += n
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([(sums / tokens[k]).astype(np.float32).tobytes()], pa.binary()), pa.array([k], pa.int64())], ["p", "k"])

    trained = learnt.sortWithinPartitions("h", "symbols").select("symbols").mapInArrow(train, "p binary, n long, k long, shard long")
    rows = trained.repartition(AVERAGERS, "k").sortWithinPartitions("k", "shard", "n", "p").mapInArrow(mean, "p binary, k long").collect()  # the slices of one model
    begin.destroy()
    return np.concatenate([np.frombuffer(r.p, dtype=np.float32) for r in sorted(rows, key=lambda r: r.k)]) if rows else model


def fitted(learnt: DataFrame, words, tokens: int) -> np.ndarray:
    """Parameters trained on `learnt` (h, symbols), round by round."""
    model, done = begun(words.value), 0
    for upto, rate in zip(ROUNDS, RATES, strict=True):
        part = F.pmod("h", F.lit(16))
        shards = int(np.clip(-(-tokens * (upto - done) // (16 * SHARD)), 1, SHARDS))
        model = averaged(learnt.where((part >= done) & (part < upto)).repartition(shards, "h"), words, model, rate)
        done = upto
    return model


def score(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", hidden: int = HIDDEN) -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score and score (log10-probabilities of the whole text). `training` marks the rows to learn from."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id).cast("string"), F.col(text))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), key.alias("h"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = shared.written(counted(rows.where("training")), "counts")
    of = vocabulary(counts, hidden)
    if not of.total:
        n_tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        zero = F.lit(0.0)
        return rows.select(F.col("id").alias(id), n_tokens.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    words = spark.sparkContext.broadcast(of)
    texts = shared.written(encoded(rows, words), "encoded")
    network = spark.sparkContext.broadcast(fitted(texts.where("training").select("h", "symbols"), words, of.total))
    words.unpersist()
    shape = of.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textio.one_thread()
        p = unpacked(network.value, shape)
        for part, symbols, bounds in groups_of(batches):
            model = pa.array(scored_on(p, symbols, bounds) + part.column("shares").to_numpy())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), model], [*columns, "model"])

    columns = ["id", "row", "n_tokens", "known", "base"]
    modelled = texts.select(*columns, "shares", "symbols").mapInArrow(run, T.StructType([*(texts.schema[c] for c in columns), T.StructField("model", T.DoubleType())]))
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.w").alias("w"), F.col("r.n").alias("m")).join(counts, "w", "left")
    n = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return modelled.join(sums, "row", "left").select(
        F.col("id").alias(id),
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(of.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
