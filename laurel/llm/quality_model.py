"""Quality classifier: support vectors over n-gram indicators scaled by Naive Bayes log-count ratios.

Features are the distinct byte n-grams (2 to 4 bytes, case kept) of a text, and the distinct n-grams (2 to 4) of
its sequence of marks that tell whether a word equals the word before, hashed to FEATURES places. With p and q
the smoothed shares of positive and negative documents that hold a feature, its indicator is scaled by log(p / q);
a linear hinge-loss model is fitted to the scaled and length-normalised indicators by dual coordinate descent, and a
logistic curve through its margins on the training rows gives the score.

Fitting uses at most FIT_ROWS labelled rows (the smallest hashes of their ids) of at most FIT_BYTES bytes of text
together: a bounded, documented sample, read by one task, so that the driver only ever holds ids and the model. Scoring
reads every text whole. The model is broadcast; its size is fixed (a float for each of FEATURES).

Nulls and empty texts have no features and get the score of the bias alone. Labels that are null are not learnt
from; of several labels of one id the smallest counts, and rows that share an id are learnt with it each. With rows of one class only, or none, every score is that
class's (or one half). Repeated rows score alike; input columns beyond id and text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.llm import textio

BITS = 18
FEATURES = 1 << BITS
GRAMS = (2, 3, 4)
#: Bounds of the labelled sample that the model is fitted on.
FIT_ROWS, FIT_BYTES = 6000, 16 << 20
#: Cost of a hinge loss, passes of dual coordinate descent, smoothing of the counts.
COST, PASSES, SMOOTH = 1.0, 30, 1.0


def slice_features(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The features of every text of a slice."""
    starts, ends, first = textio.word_bounds(buf, offsets, textio.NOT_SPACE)
    hashes = textio.word_hashes(buf, starts, ends)
    same = np.zeros(len(hashes), dtype=np.uint8)
    same[1:] = hashes[1:] == hashes[:-1]
    return [features(buf[a:b], same[c + 1 : d]) for a, b, c, d in zip(offsets[:-1], offsets[1:], first[:-1], first[1:], strict=True)]


def features(buf: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text's bytes and of its marks of repeated words, ascending."""
    marks = [_grams(same, n, 64) for n in GRAMS]
    if len(buf) < 60_000:
        return np.unique(np.concatenate([*(_grams(buf, n) for n in GRAMS), *marks]))
    seen = np.zeros(FEATURES, dtype=bool)
    for found in marks:
        seen[found] = True
    for at in range(0, len(buf), 1 << 18):  # long texts in overlapping pieces
        for n in GRAMS:
            seen[_grams(buf[at : at + (1 << 18) + n - 1], n)] = True
    return np.flatnonzero(seen)


def _grams(buf: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    size = max(0, len(buf) - n + 1)
    value = np.full(size, n + kind, dtype=np.uint32)
    for k in range(n):
        value = value * np.uint32(257) + buf[k : k + size]
    value = value * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    return ((value * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))), margin = mean-free sum of the weights of a text's features over the root of their number."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


@dataclass
class Rows:
    """The features of many texts in one array, text after text."""

    flat: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]


def rows_of(batches: Iterable[pa.RecordBatch]) -> tuple[Rows, np.ndarray]:
    """Features and labels of batches (text, y): few large arrays instead of many small ones, so that the task gives their memory back."""
    parts, sizes, labels = [np.zeros(0, np.int32)], [], []
    for part, buf, offsets in textio.slices(batches, "text"):
        found = slice_features(buf, offsets)
        sizes += map(len, found)
        parts.append(np.concatenate(found, dtype=np.int32, casting="same_kind"))
        labels += part.column("y").to_pylist()
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.empty(bounds[-1], dtype=np.int32)
    end = len(flat)
    while parts:  # each part goes as it is copied
        part = parts.pop()
        flat[end - len(part) : end] = part
        end -= len(part)
    return Rows(flat, bounds), np.array(labels, dtype=np.int64)


def log_count_ratios(rows: Rows, labels: np.ndarray) -> np.ndarray:
    """log(p / q) of every feature; p and q are its smoothed counts among positive and negative rows over their sums."""
    counts = [np.full(FEATURES, SMOOTH), np.full(FEATURES, SMOOTH)]
    for i, label in enumerate(labels.tolist()):
        counts[label][rows[i]] += 1
    sizes = [max(1, int((labels == k).sum())) + 2 * SMOOTH for k in (0, 1)]
    return np.log(counts[1] / sizes[1]) - np.log(counts[0] / sizes[0])


def dual_coordinate_descent(rows: Rows, scale: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (already multiplied by `scale`) and bias of the L1-loss linear support vector machine; classes weigh alike."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = {1: (labels == 1).mean(), 0: (labels == 0).mean()}
    cost = COST * np.array([0.5 / share[int(x)] for x in labels])
    short = 1 / np.sqrt(np.maximum(1, np.diff(rows.bounds)))
    square = np.array([float(np.square(scale[rows[i]] * short[i]).sum()) + 1.0 for i in range(len(rows))])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = rows[i]
            values = scale[own] * short[i]
            gradient = sign[i] * (float(weights[own] @ values) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weights[own] += step * sign[i] * values
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights * scale, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, towards labels drawn a little to the middle; a small ridge keeps it finite."""
    high, low = (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2)
    target = np.where(labels == 1, high, low)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w * np.array([1, 0]))
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fitted(batches: Iterable[pa.RecordBatch]) -> Model:
    """A model from batches (text, y)."""
    rows, y = rows_of(batches)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES, np.float32), 0.0, 1.0, 0.0 if not len(y) else 4.0 * (2 * int(y[0]) - 1))
    weights, bias = dual_coordinate_descent(rows, log_count_ratios(rows, y), y)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    model.slope, model.offset = logistic(np.array([model.margin(rows[i]) for i in range(len(rows))]), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """A model from the rows of `docs` that have a label 0 or 1, within the bounds of the sample.

    Of the first `rows` ids in hash order, those whose texts do not fit into what is left of `size` are left out, and later ones go on.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sizes = found.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"))
    at, wanted = 0, []
    for row in sizes.orderBy(F.xxhash64("id"), "id").collect():  # at most `rows` ids
        if at + row.n <= size:
            at += row.n
            wanted.append((row.id, row.y))
    sample = spark.createDataFrame(wanted, T.StructType([T.StructField("id", sizes.schema["id"].dataType), T.StructField("y", T.IntegerType())]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fitted(batches)
        textio.give_back()
        yield pa.RecordBatch.from_pylist([{"weights": made.weights.tobytes(), "bias": made.bias, "slope": made.slope, "place": made.offset}])

    learnt = found.join(F.broadcast(sample), "id").repartition(1).sortWithinPartitions("id", "text").select("text", "y")  # at most `size` bytes
    made = learnt.mapInArrow(learn, "weights binary, bias double, slope double, place double").collect()
    return Model(np.frombuffer(made[0].weights, dtype=np.float32), made[0].bias, made[0].slope, made[0].place) if made else fitted([])


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id and score (0 to 1) of the whole text; with `keep`, all columns of `docs` (a "score" among them is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score") if keep else docs.select(id, text)
    names = rows.columns if keep else [id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in textio.slices(batches, text):
            scores = [shared.value.score(found) for found in slice_features(buf, offsets)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])
        textio.give_back()

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("score", T.DoubleType())]))
