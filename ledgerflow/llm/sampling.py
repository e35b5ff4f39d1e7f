"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from all learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold.

    The rows are those whose id hashes lowest: a fixed choice that does not depend on the
    layout of the tables. Null labels and ids are left out; of repeated labels of one id the
    lower counts. The chosen labels are bounded by ``rows`` and so may be broadcast.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).cast("long").alias("sample_id"))
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(rows)
    )
    found = docs.select(F.col(key).cast("long").alias("sample_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return found.join(F.broadcast(chosen), "sample_id").orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows).select("text", "label")


def logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights, the level last, of the logistic curve over the rows of ``x`` that fits the
    labels best; targets are drawn in a little, so separable labels give finite weights."""
    n1 = label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    x = np.vstack([x, np.ones(len(label))])
    w = np.zeros(len(x))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(len(x)), x @ (target - p) - 1e-4 * w)
        w += np.clip(step, -3, 3)
    return w
