"""Exact top-k search by inner product: columnar branch and bound.

Vectors lie in vertical layout, one row of the matrix per dimension. For a query the inner
products grow one block of dimensions after another; after each block the candidates whose
partial product plus the most that the remaining dimensions can add (the product of the
remaining norms) stays below the query's k-th best so far are dropped, and the survivors are
compacted. The bound is inclusive, so ties are never lost.

Null vectors and vectors with a null or non-finite component take no part. Vectors of
different length are padded with zeros; scores outside the range of a long stop at its ends. A row never answers a query of its own id; of
repeated ids each row counts as a candidate, and a repeated query id asks once. Queries are
taken in chunks of a fixed size, each against all candidates where they lie: nothing but a
chunk of queries moves, and each task returns its own k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.tables import stored

QUERIES_AT_ONCE = 8_192
BLOCK = 16
ROWS_AT_ONCE = 8_192


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): usable vectors with components ``floor(scale * x)``."""
    x = F.col(vector)
    usable = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return vectors.filter(usable).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double")).alias("v"),
    )


def matrix(rows: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """The vectors as columns of a (dims, rows) matrix, shorter ones padded with zeros."""
    ends = np.asarray(rows.offsets)
    flat = np.asarray(rows.values)[ends[0] : ends[-1]].astype(float)
    sizes = np.diff(ends)
    dims = max(int(sizes.max(initial=0)), dims or 0)
    out = np.zeros((dims, len(rows)))
    out[np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes), np.repeat(np.arange(len(rows)), sizes)] = flat
    return out


def remaining_norms(m: np.ndarray) -> np.ndarray:
    """Row b: norms over the dimensions from block b on; one more row of zeros."""
    blocks = [np.square(m[at : at + BLOCK]).sum(0) for at in range(0, len(m), BLOCK)]
    return np.sqrt(np.cumsum([np.zeros(m.shape[1]), *blocks[::-1]], axis=0)[::-1])


class Best:
    """The k best (score, id) per query so far, and the score to beat."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = remaining_norms(queries)
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)

    def offer(self, ids: np.ndarray, columns: np.ndarray) -> None:
        dims = max(len(columns), len(self.queries))
        if len(columns) < dims:
            columns = np.vstack([columns, np.zeros((dims - len(columns), columns.shape[1]))])
        if len(self.queries) < dims:
            self.queries = np.vstack([self.queries, np.zeros((dims - len(self.queries), len(self.ids)))])
            self.norms = remaining_norms(self.queries)
        norms = remaining_norms(columns)
        exact = np.abs(columns).max(initial=0) * np.abs(self.queries).max(initial=0) * max(dims, 1) < 2**52
        if not exact:  # beyond the integers a double holds: whole products in Python's integers
            columns, queries = columns.astype(object), self.queries.astype(object)
            columns, queries = np.frompyfunc(int, 1, 1)(columns), np.frompyfunc(int, 1, 1)(queries)
        step = 64
        for at in range(0, len(self.ids), step):
            heads = (self.queries[:BLOCK, at : at + step].T @ columns[:BLOCK]) if exact else None
            for q in range(at, min(at + step, len(self.ids))):
                self.search(q, ids, columns, norms, heads[q - at]) if exact else self.merge(q, ids, queries[:, q] @ columns)

    def search(self, q: int, ids: np.ndarray, columns: np.ndarray, norms: np.ndarray, score: np.ndarray) -> None:
        least = self.scores[q][self.k - 1] if len(self.scores[q]) >= self.k else -np.inf
        alive = None
        for b, at in enumerate(range(0, len(columns), BLOCK)):
            if b:
                block = columns[at : at + BLOCK]
                score = score + self.queries[at : at + BLOCK, q] @ (block if alive is None else block[:, alive])
            rest = norms[b + 1] if alive is None else norms[b + 1][alive]
            # One unit of slack covers rounding in the norms; products are whole numbers.
            keep = np.flatnonzero(score + self.norms[b + 1, q] * rest * (1 + 1e-9) + 1 >= least)
            score = score[keep]
            alive = keep if alive is None else alive[keep]
            if not len(keep):
                return
        if alive is not None:
            ids = ids[alive]
        self.merge(q, ids, score)

    def merge(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        others = ids != self.ids[q]
        score = np.concatenate([self.scores[q], score[others]])
        ids = np.concatenate([self.found[q], ids[others]])
        order = np.lexsort((ids, -score))[: self.k]
        self.scores[q], self.found[q] = score[order], ids[order]


def local_best(ids: np.ndarray, queries: np.ndarray, k: int):
    """A partition's own k best for every query of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(ids, queries, k), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows, seen = batch.slice(at, ROWS_AT_ONCE), True
                best.offer(np.asarray(rows.column(0)), matrix(rows.column(1)))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, [len(s) for s in best.scores])),
                    pa.array(np.concatenate(best.found)),
                    pa.array([min(max(int(s), -(2**63)), 2**63 - 1) for part in best.scores for s in part], pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, **columns: str) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest products, ties to smaller ids."""
    known = stored(quantised(vectors, **columns), "vectors")
    asked = known.filter(is_query).dropDuplicates(["vec_id"])
    n = asked.count()
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-2 * n // QUERIES_AT_ONCE))))
    parts = []
    for chunk in range(max(1, -(-2 * n // QUERIES_AT_ONCE))):
        rows = asked.filter(part == chunk).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        vector = rows.column("v").combine_chunks()
        parts.append(known.mapInArrow(local_best(np.asarray(rows.column("vec_id")), matrix(vector), k), "query_id long, vec_id long, score long"))
    if not parts:
        return known.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
