"""Hard negatives for anchors among labelled vectors: Fagin's threshold algorithm.

Anchors and candidates meet in cells, one part of the anchors against one part of the
candidates. In a cell the candidates come in chunks; every chunk has one sorted list per
dimension. For an anchor the lists are read from the end that its sign of the dimension
prefers, a row met for the first time is scored in full by random access, and reading stops
once the threshold, the score a row at the current depth of all lists would have, falls
strictly below what each window still needs: its k-th score so far, or its lower end while it
holds fewer than k rows. The bound is strict, so ties are never lost. The best of the cells are
merged by a window of at most k rows per cell.

First each anchor's positives are found among the rows of its own label, then for every
positive the best rows of other labels with a score between two shares of the positive's.

Rows with a null id, label or vector, or a null or non-finite component take no part; other
columns are ignored, and an empty table gives no rows. Shorter vectors are padded with zeros;
an anchor whose components are all zero scores 0 everywhere. Ties go to the smaller id. Repeated
rows are candidates each, but a row never answers an anchor of its own id, and an id asks once,
by its smallest (label, vector). Scores beyond the range of a long stop at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.tables import stored

ROWS_AT_ONCE = 8_192  # candidates with sorted lists in memory at a time
ANCHORS_IN_CELL = 16_384
SCORES_IN_CELL = 1 << 22  # of a small table; a large one has larger cells, at most MOST_CELLS
MOST_CELLS = 100_000
FIRST_DEPTH = 16
LEAST, MOST = -(2**63), 2**63 - 1
CELL = ["of_label", "part", "side"]


def labelled(vectors: DataFrame, key: str, label: str, vector: str, scale: int) -> DataFrame:
    """(row, vec_id, label, v): usable rows with components ``floor(scale * x)`` and a number of their own."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite
    return vectors.filter(usable).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("v"),
    )


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The vectors as rows of a matrix of longs, shorter ones padded with zeros."""
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def padded(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] >= dims else np.hstack([m, np.zeros((len(m), dims - m.shape[1]), m.dtype)])


def largest(m: np.ndarray) -> int:
    return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))


def whole(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond a long stop at its ends."""
    return np.array([min(max(s, LEAST), MOST) for s in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


class Lists:
    """A chunk of candidates with one ascending list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows, self.size = ids, labels, rows, largest(rows)
        self.order = np.argsort(rows.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(np.ascontiguousarray(rows.T), self.order, 1)
        self.doubles = rows.astype(float)
        self.objects: np.ndarray | None = None

    def arithmetic(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchor in doubles where every sum is a whole number that a double holds, else in Python's integers."""
        if self.size * largest(anchor) * max(len(anchor), 1) < 2**52:
            return self.doubles, anchor.astype(float)
        if self.objects is None:
            self.objects = np.frompyfunc(int, 1, 1)(self.rows)
        return self.objects, np.frompyfunc(int, 1, 1)(anchor)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, best: Best) -> None:
        """Offer ``best`` every allowed row that could still be among its answers."""
        n = len(self.ids)
        rows, q = self.arithmetic(anchor)
        used = np.flatnonzero(anchor)
        down = anchor[used] > 0
        seen = ~allowed
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            reached = min(n, depth + step) if len(used) else n
            places = np.arange(depth, reached)
            places = np.where(down[:, None], n - 1 - places, places)
            fresh = np.full(n, not len(used))
            fresh[self.order[used[:, None], places]] = True
            met = np.flatnonzero(fresh & ~seen)
            if len(met):
                seen[met] = True
                best.offer(self.ids[met], whole(rows[met] @ q))
            if seen.all():
                return
            edge = self.sorted[used, places[:, -1]]
            edge = edge.astype(float) if rows is self.doubles else np.frompyfunc(int, 1, 1)(edge)
            if int(whole(np.array([(edge * q[used]).sum()], rows.dtype))[0]) < best.needed():
                return
            depth, step = reached, step * 2


class Best:
    """The k best (score, id) of each window [low, high] of an anchor."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.windows, self.k = [(max(low, LEAST), min(high, MOST)) for low, high in windows], k
        self.scores = [np.zeros(0, np.int64) for _ in windows]
        self.ids = [np.zeros(0, np.int64) for _ in windows]

    def needed(self) -> int:
        """A row with a smaller score changes no window."""
        ends = [int(s[-1]) if len(s) >= self.k else low for s, (low, high) in zip(self.scores, self.windows, strict=True) if low <= high]
        return min(ends, default=MOST)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w, (low, high) in enumerate(self.windows):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            if not len(inside):
                continue
            score = np.concatenate([self.scores[w], scores[inside]])
            id_ = np.concatenate([self.ids[w], ids[inside]])
            # Descending without negation, which the least long does not survive.
            order = np.lexsort((id_, ~score))[: self.k]
            self.scores[w], self.ids[w] = score[order], id_[order]


def in_cells(k: int, same_label: bool, low: int, high: int):
    """Answers of sorted cells: anchors (kind 0) come before their candidates (kind 1)."""

    def windows(scores: list[int] | None) -> list[tuple[int, int]]:
        return [(LEAST, MOST)] if scores is None else [(-(-low * s // 100), high * s // 100) for s in scores]

    def answers(anchors: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [(a, slot, i, s) for a, _, _, best in anchors for slot in range(len(best.ids)) for i, s in zip(best.ids[slot], best.scores[slot], strict=True)]
        if found:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "slot", "vec_id", "score"])

    def meet(anchors: list[tuple], rows: pa.RecordBatch) -> None:
        m = padded(rows_of(rows.column(6)), max(len(a[2]) for a in anchors))
        lists = Lists(np.asarray(rows.column(4)), np.asarray(rows.column(5)), m)
        for anchor, label, v, best in anchors:
            fits = ((lists.labels == label) == same_label) & (lists.ids != anchor)
            if fits.any():
                lists.search(padded(v[None, :], m.shape[1])[0], fits, best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors = None, []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                here = tuple(keys[:3, begin])
                if here != cell:
                    yield from answers(anchors)
                    cell, anchors = here, []
                part = batch.slice(begin, end - begin)
                if keys[3, begin] == 0:
                    asked = zip(part.column(4).to_pylist(), part.column(5).to_pylist(), rows_of(part.column(6)), part.column(7).to_pylist(), strict=True)
                    anchors += [(i, label, v, Best(windows(scores), k)) for i, label, v, scores in asked]
                elif anchors:
                    for at in range(0, part.num_rows, ROWS_AT_ONCE):
                        meet(anchors, part.slice(at, ROWS_AT_ONCE))
        yield from answers(anchors)

    return run


def parts(anchors: Column, rows: Column) -> tuple[Column, Column]:
    """(parts of the anchors, parts of the candidates) for so many of either."""
    side = F.ceil(anchors / ANCHORS_IN_CELL)
    cells = F.least(F.ceil(anchors.cast("double") * rows / SCORES_IN_CELL), F.lit(MOST_CELLS))
    return side, F.greatest(F.ceil(cells / side), F.lit(1))


def searched(asked: DataFrame, known: DataFrame, sizes: DataFrame, k: int, same_label: bool, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor_id, slot, vec_id, score): per cell, the ``k`` best of each window of each anchor.

    ``sizes`` (of_label, sides, parts) deals anchors and candidates label by label; where labels
    differ it has one row for all.
    """
    sizes = stored(sizes, "cells")
    cells = sizes.agg(F.sum(F.col("sides") * F.col("parts"))).first()[0] or 1
    columns = [*CELL, "kind", "vec_id", "label", "v", "scores"]

    def sized(rows: DataFrame) -> DataFrame:
        if same_label:
            return rows.withColumn("of_label", F.col("label")).join(sizes, "of_label")
        only = sizes.first() or {"sides": 1, "parts": 1}
        return rows.withColumns({"of_label": F.lit(0).cast("long")} | {c: F.lit(only[c]).cast("long") for c in ("sides", "parts")})

    anchors = sized(asked)
    anchors = anchors.withColumn("side", F.pmod(F.xxhash64("vec_id"), "sides")).withColumn("kind", F.lit(0).cast("long"))
    anchors = anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = sized(known)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), "parts")).withColumn("kind", F.lit(1).cast("long"))
    rows = rows.withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).withColumn("scores", F.lit(None).cast("array<long>"))
    dealt = anchors.select(columns).unionByName(rows.select(columns)).repartition(min(4 * int(cells), MOST_CELLS), *CELL)
    return dealt.sortWithinPartitions(*CELL, "kind").mapInArrow(in_cells(k, same_label, low, high), "anchor_id long, slot int, vec_id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an
    anchor's ``positives`` best rows of its own label, the ``negatives`` best rows of other labels
    that score at least ``low`` and at most ``high`` per cent of the positive.

    ``is_anchor`` speaks of the column ``vec_id``.
    """
    known = stored(labelled(vectors, key, label, vector, scale), "labelled")
    anchors = known.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v")
    anchors = stored(anchors, "anchors")

    # Positives: cells of one label each.
    asked = anchors.groupBy("label").agg(F.count("*").alias("anchors"))
    sizes = known.groupBy("label").agg(F.count("*").alias("rows")).join(asked, "label")
    sides, split = parts(F.col("anchors"), F.col("rows"))
    sizes = sizes.select(F.col("label").alias("of_label"), sides.alias("sides"), split.alias("parts"))
    alone = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    pairs = first(searched(alone, known, sizes, positives, True), positives)
    pairs = stored(pairs.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives: cells over all labels; an anchor brings at most ``positives`` windows.
    windows = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p.positive_score).alias("scores"))
    asked = anchors.join(windows, "vec_id")
    both = known.select(F.lit(1).alias("rows"), F.lit(0).alias("anchors")).unionByName(windows.select(F.lit(0).alias("rows"), F.lit(1).alias("anchors")))
    sizes = both.agg(F.sum("rows").alias("rows"), F.sum("anchors").alias("anchors"))
    sides, split = parts(F.col("anchors"), F.col("rows"))
    sizes = sizes.filter("anchors > 0").select(F.lit(0).cast("long").alias("of_label"), sides.alias("sides"), split.alias("parts"))
    found = first(searched(asked, known, sizes, negatives, False, low, high), negatives)
    found = found.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
