"""Quality classifier: support vectors over n-grams scaled by naive Bayes.

A text's features are indicators of its n-grams: every four bytes in a row, every pair of
neighbouring words, and whether a word follows itself twice; they are hashed to a fixed
number of columns. Each column is scaled by the log-count ratio of the classes, rows are
scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
A logistic curve over the margins gives scores from 0 to 1.

The fit sees at most ``SAMPLE_ROWS`` labelled rows and runs in one task over them; scoring is
one pass without shuffle over whole texts. Null and empty texts have no n-grams and get the
score of the bias alone. With labels of one class only, or none, every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.sampling import held_out, labelled_sample, logistic
from ledgerflow.llm.text import BASE, mix, runs, span_hashes, words

BITS = 18
SAMPLE_ROWS = 6_000
EPOCHS = 12
COST = 1.0
THRESHOLD = 0.3

_last = np.zeros(1 << BITS, np.int64)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, first column of each row and one past the last), repeats included."""
    start, end, first = words(data, offsets)
    hashes = span_hashes(data, start, end)
    top = np.uint64(64 - BITS)
    pair = (mix(hashes[:-1] * np.uint64(BASE) + hashes[1:]) >> top).astype(np.int64) if len(hashes) > 1 else np.zeros(0, np.int64)
    if len(hashes) > 2:
        again = (hashes[:-2] == hashes[1:-1]) & (hashes[1:-1] == hashes[2:])
        pair[:-1][again] = 0
    wide = data.astype(np.uint32)
    quad = np.zeros(len(data), np.int64)
    if len(data) > 3:
        four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        four = (four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        quad[:-3] = four * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)
    parts, ends = [], [0]
    for a, b, f, g in zip(offsets[:-1], offsets[1:], first[:-1], first[1:], strict=True):
        parts += [quad[a : max(a, b - 3)], pair[f : max(f, g - 1)]]
        ends.append(ends[-1] + len(parts[-2]) + len(parts[-1]))
    return np.concatenate(parts) if parts else quad[:0], np.array(ends)


def distinct(columns: np.ndarray) -> np.ndarray:
    """The distinct columns of one row: a column stays where it was seen last."""
    place = np.arange(len(columns))
    _last[columns] = place
    return columns[_last[columns] == place]


@dataclass
class Model:
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        columns, ends = ngrams(data, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        for row, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                seen = distinct(columns[a:b])
                out[row] += self.weights[seen].sum() / max(np.sqrt(self.squares[seen].sum()), 1e-12)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.level, -30, 30)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Hinge-loss weights over the scaled unit rows, and a bias, one dual variable at a time."""
    values = [scale[r] for r in rows]
    sizes = [max(float(np.sqrt((v * v).sum())), 1e-12) for v in values]
    values = [v / s for v, s in zip(values, sizes, strict=True)]
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            gradient = y * (weights[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost)  # unit row and bias: curvature 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[r] += step * v
                bias += step
                alpha[i] = new
    return weights, bias


def fit_rows(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """The model for rows of distinct columns."""
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        level = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, level)
    counts = np.ones((2, 1 << BITS))
    for r, y in zip(rows, label, strict=True):
        counts[y, r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # Margins of rows left out of the fit, so that the curve is not drawn on rows known by heart.
    part = np.arange(len(rows)) % 3
    sign = np.where(label == 1, 1.0, -1.0)
    margin = np.zeros(len(rows))

    def sized(r: np.ndarray) -> float:
        return max(float(np.sqrt((ratio[r] ** 2).sum())), 1e-12)

    for fold in range(3):
        inside = np.flatnonzero(part != fold)
        w, b = dual_descent([rows[i] for i in inside], ratio, sign[inside], COST, EPOCHS)
        for i in np.flatnonzero(part == fold):
            margin[i] = w[rows[i]] @ ratio[rows[i]] / sized(rows[i]) + b
    slope, level = logistic(margin[None], label)
    w, b = dual_descent(rows, ratio, sign, COST, EPOCHS)
    return Model(w * ratio, ratio**2, b, slope, level)


def fitted(sample: DataFrame) -> Model:
    """Fit in one Spark task over (text, label) rows; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label = [], []
        for batch in batches:
            for part, data, offsets in runs(batch, "text"):
                columns, ends = ngrams(data, offsets)
                rows += [distinct(columns[a:b]).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                label += part.column(1).to_pylist()
        m = fit_rows(rows, np.array(label, int))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.weights.tobytes()]), pa.array([m.squares.tobytes()]), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.level])],
            names=["weights", "squares", "bias", "slope", "level"],
        )

    row = sample.coalesce(1).mapInArrow(run, "weights binary, squares binary, bias double, slope double, level double").head()
    return Model(np.frombuffer(row.weights), np.frombuffer(row.squares), row.bias, row.slope, row.level) if row else fit_rows([], np.zeros(0, int))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                score = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score)], names=["doc_id", "score"])

    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **columns: str) -> DataFrame:
    """Learn from ``labels.quality`` outside the held-out fold and score every document."""
    return scored(docs, fitted(labelled_sample(docs, labels, "quality", sample_rows, **columns)), **columns)


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, text: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, "quality", sample_rows, text=text, **columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, text):
                yield rows.filter(pa.array(shared.value.scores(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
