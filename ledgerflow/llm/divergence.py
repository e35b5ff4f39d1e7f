"""How far sources of a language differ in their words: K-squared quadtree over the group-term matrix.

A group is a (lang, source) pair, its row of the matrix counts the kept terms of its texts. Per
language the matrix is cut into square tiles; every tile that holds anything is a quadtree, its
nodes kept level by level as the numbers of the quadrants that are not all zero (in Morton
order, so a quadrant's children are its number times four and on), with the dense cells of the
smallest quadrants as leaves.

Two groups differ in a term by the distance of their smoothed shares. Where neither has the term,
this distance is the same for every term, so it is priced once per term without looking: a pair
starts with the price of all-zero rows, and the trees of two row blocks are then walked down
together, through quadrants that are not zero on both sides, to leaves that add what the
cells change. A task holds two row blocks and runs through their tiles in order; a run of many
tiles is dealt to several tasks, whose sums add up.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. Null text, lang and
source read as empty. Every occurring group is answered for, also without any kept term.
Shares are whole numbers, computed as decimals in Spark, so nothing is rounded. Repeated rows are
documents each; texts are read whole, whatever their length; an empty table gives no rows; other
columns are ignored. Equal values are ranked by item, in the order of UTF-8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.tables import stored

SCALE = 1_000_000_000
SIDE = 512  # rows and columns of a tile
LEAF = 16  # rows and columns of the smallest quadrants
TILES_IN_RUN = 32  # tiles of one pair of row blocks that one task takes
TERMS_IN_BUCKET = 4_096
LEAVES_AT_ONCE = 128
FLUSH_BYTES = 64_000_000  # of counts that a task holds before it hands them on
ENTRY_BYTES = 300

#: Bytes of terms, lower-cased; all others become spaces.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PAIR = ["lang", "a", "b", "run"]


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per group, summed up inside each task first."""

    def rows(counts: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            # Every group gives a row of its own, without a term.
            names = [None, *(t.decode() for t in terms)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(names)),
                    pa.array([source] * len(names)),
                    pa.array(names, pa.string()),
                    pa.array([0, *terms.values()], pa.int64()),
                    pa.array([0, *(docs[lang, source][t] for t in terms)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, held = {}, {}, 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for group, body in zip(groups, pc.cast(batch.column(2), pa.binary()), strict=True):
                terms = body.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                once = set(terms)
                if group not in counts:
                    counts[group], docs[group] = Counter(), Counter()
                known = len(docs[group])
                counts[group].update(terms)
                docs[group].update(once)
                new = len(docs[group]) - known
                held += new * (ENTRY_BYTES + sum(map(len, once)) // max(len(once), 1))
                if held > FLUSH_BYTES:
                    yield from rows(counts, docs)
                    counts, docs, held = {}, {}, 0
        yield from rows(counts, docs)

    chosen = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    made = chosen.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(frame: DataFrame, bucket, order: list, name: str) -> DataFrame:
    """``frame`` with numbers from 0 per language: by bucket, and inside a bucket by ``order``.

    Only a bucket is ever numbered in one task; the bucket sizes are summed up apart."""
    frame = frame.withColumn("bucket", bucket)
    sizes = frame.groupBy("lang", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lang", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)) - 1
    return frame.withColumn("inside", inside).join(starts, ["lang", "bucket"]).withColumn(name, (F.col("start") + F.col("inside")).cast("long")).drop("bucket", "inside", "start")


def share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exact; 0 where there are no terms."""
    return F.expr(f"IF({terms} = 0, 0L, 1 + ({SCALE} * CAST({n} + 5 AS DECIMAL(20, 0))) DIV (CAST({total} AS DECIMAL(20, 0)) + 5 * CAST({terms} AS DECIMAL(20, 0))))")


def morton(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Quadrant numbers: the bits of row and column in turn."""
    out = np.zeros(len(row), np.int64)
    for bit in range(int(SIDE // LEAF).bit_length()):
        out |= ((row >> bit & 1) << (2 * bit + 1)) | ((column >> bit & 1) << (2 * bit))
    return out


class Tree:
    """The quadtree of one tile: non-zero quadrants per level, and the leaves' cells as change from the all-zero share."""

    def __init__(self, cell: np.ndarray, value: np.ndarray, zero: np.ndarray):
        row, column = cell // SIDE, cell % SIDE
        leaf = morton(row // LEAF, column // LEAF)
        self.levels = [np.unique(leaf)]
        while self.levels[0][-1] > 0:
            self.levels.insert(0, np.unique(self.levels[0] >> 2))
        depth = int(SIDE // LEAF).bit_length()
        self.levels = [np.zeros(1, np.int64)] * (depth - len(self.levels)) + self.levels
        # Dense leaves of shares; row by row the all-zero share where no cell is.
        first = np.zeros(len(self.levels[-1]), np.int64)
        for bit in range(depth):
            first |= (self.levels[-1] >> (2 * bit + 1) & 1) << bit
        self.dense = np.broadcast_to(zero.reshape(-1, LEAF)[first][:, :, None], (len(first), LEAF, LEAF)).copy()
        self.dense[np.searchsorted(self.levels[-1], leaf), row % LEAF, column % LEAF] = value

    def holds(self, level: int, quadrants: np.ndarray) -> np.ndarray:
        known = self.levels[level]
        return known[np.minimum(np.searchsorted(known, quadrants), len(known) - 1)] == quadrants

    def leaves(self, quadrants: np.ndarray, zero: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cells of leaf quadrants; those that are all zero are flat."""
        out = np.broadcast_to(zero.reshape(-1, LEAF)[rows][:, :, None], (len(rows), LEAF, LEAF)).copy()
        there = self.holds(-1, quadrants)
        out[there] = self.dense[np.searchsorted(self.levels[-1], quadrants[there])]
        return out


def changes(one: Tree | None, other: Tree | None, zero: np.ndarray, zero_other: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (rows of one, rows of other) how the cells of a tile column change the
    distance of all-zero rows. Node pairs (row quadrant of one, of other, column quadrant) go
    down together while either of the two holds something."""
    up = left = column = np.zeros(1, np.int64)
    tree = one or other
    depth = len(tree.levels)

    def filled(side: Tree | None, level: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return side.holds(level, morton(row, column)) if side else np.zeros(len(row), bool)

    for level in range(1, depth):
        step = np.arange(8)
        up, left, column = ((2 * axis[:, None] + (step >> bit & 1)).ravel() for axis, bit in ((up, 2), (left, 1), (column, 0)))
        keep = filled(one, level, up, column) | filled(other, level, left, column)
        up, left, column = up[keep], left[keep], column[keep]
    for at in range(0, len(up), LEAVES_AT_ONCE):
        a, b, c = up[at : at + LEAVES_AT_ONCE], left[at : at + LEAVES_AT_ONCE], column[at : at + LEAVES_AT_ONCE]
        flat = [np.broadcast_to(z.reshape(-1, LEAF)[r][:, :, None], (len(r), LEAF, LEAF)) for z, r in ((zero, a), (zero_other, b))]
        x = one.leaves(morton(a, c), zero, a) if one else flat[0]
        y = other.leaves(morton(b, c), zero_other, b) if other else flat[1]
        apart = np.abs(x[:, :, None, :] - y[:, None, :, :]).sum(-1) - LEAF * np.abs(flat[0][:, :, None, 0] - flat[1][:, None, :, 0])
        np.add.at(total, (a[:, None, None] * LEAF + np.arange(LEAF)[None, :, None], b[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]), apart)


class Blocks:
    """Two row blocks and the sum of their pairs so far."""

    def __init__(self, key: tuple):
        self.key = key
        self.zero: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        self.columns = 0
        self.tile, self.cells = -1, {}
        self.total = np.zeros((SIDE, SIDE), np.int64)

    def head(self, block: int, rows: np.ndarray, shares: np.ndarray, columns: int) -> None:
        zero = np.zeros(SIDE, np.int64)
        zero[rows] = shares
        self.zero[block], self.rows[block], self.columns = zero, rows, columns

    def add(self, block: int, tile: int, cells: np.ndarray, values: np.ndarray) -> None:
        if tile != self.tile:
            self.walk()
            self.tile = tile
        self.cells.setdefault(block, []).append((cells, values))

    def walk(self) -> None:
        if self.cells:
            _, a, b, _ = self.key
            trees = {block: Tree(*map(np.concatenate, zip(*parts, strict=True)), self.zero[block]) for block, parts in self.cells.items()}
            changes(trees.get(a), trees.get(b), self.zero[a], self.zero[b], self.total)
            self.cells = {}

    def batch(self) -> pa.RecordBatch:
        """All pairs of rows of the two blocks, the price of all-zero columns included."""
        self.walk()
        lang, a, b, _ = self.key
        total = self.total + self.columns * np.abs(self.zero[a][:, None] - self.zero[b][None, :])
        one, other = (m.ravel() for m in np.meshgrid(self.rows[a], self.rows[b], indexing="ij"))
        keep = one < other if a == b else np.ones(len(one), bool)
        one, other = one[keep], other[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(one), pa.string()), pa.array(a * SIDE + one), pa.array(b * SIDE + other), pa.array(total[one, other])],
            names=["lang", "x", "y", "value"],
        )


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (pair of blocks, run): a head per block (tile -1), then the tiles by column,
    a matrix row of a tile at a time."""
    blocks: Blocks | None = None
    for batch in batches:
        for n in range(batch.num_rows):
            lang, a, b, run, tile, block, columns = (batch.column(c)[n].as_py() for c in range(7))
            if blocks is None or blocks.key != (lang, a, b, run):
                if blocks is not None:
                    yield blocks.batch()
                blocks = Blocks((lang, a, b, run))
            cells, values = (np.asarray(batch.column(c)[n].values, np.int64) for c in (7, 8))
            if tile < 0:
                blocks.head(block, cells, values, columns)
            else:
                blocks.add(block, tile, cells, values)
    if blocks is not None:
        yield blocks.batch()


def pair_values(groups: DataFrame, cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, x, y, value) for all row numbers x < y of a language.

    ``groups``: lang, row, zero; ``cells``: lang, row, col, p; ``sizes``: lang, groups, terms."""
    runs = F.greatest(F.ceil(F.col("terms") / (SIDE * TILES_IN_RUN)), F.lit(1)).cast("long")
    sizes = sizes.select("lang", "terms", F.ceil(F.col("groups") / SIDE).cast("long").alias("blocks"), runs.alias("runs"))
    inside = lambda one, two: F.struct(one.cast("int").alias("at"), two.cast("long").alias("p"))
    lists = [F.transform("content", lambda c: c.at).alias("cells"), F.transform("content", lambda c: c.p).alias("values")]

    heads = groups.groupBy("lang", F.expr(f"row DIV {SIDE}").alias("block")).agg(F.collect_list(inside(F.col("row") % SIDE, F.col("zero"))).alias("content"))
    heads = heads.select("lang", "block", *lists).join(sizes, "lang").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    heads = heads.withColumn("tile", F.lit(-1).cast("long"))
    # A run prices its own columns; the last may hold fewer.
    span = SIDE * TILES_IN_RUN
    heads = heads.withColumn("columns", F.least(F.col("terms") - F.col("run") * span, F.lit(span)))

    # At most SIDE cells a row, so that no Arrow batch grows with the matrix.
    where = [F.expr(f"row DIV {SIDE}").alias("block"), F.expr(f"col DIV {SIDE}").alias("tile"), "row"]
    at = (F.col("row") % SIDE) * SIDE + F.col("col") % SIDE
    tiles = cells.groupBy("lang", *where).agg(F.collect_list(inside(at, F.col("p"))).alias("content")).select("lang", "block", "tile", *lists)
    tiles = tiles.join(sizes, "lang").withColumn("run", F.expr(f"tile DIV {TILES_IN_RUN}")).withColumn("columns", F.lit(0).cast("long"))

    made = heads.select("lang", "block", "blocks", "run", "tile", "columns", "cells", "values").unionByName(
        tiles.select("lang", "block", "blocks", "run", "tile", "columns", "cells", "values")
    )
    # Every block meets every block, itself once.
    made = made.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    made = made.withColumn("a", F.least("block", "partner")).withColumn("b", F.greatest("block", "partner"))
    dealt = made.select(*PAIR, "tile", "block", "columns", "cells", "values").repartition(*PAIR).sortWithinPartitions(*PAIR, "tile")
    values = dealt.mapInArrow(walked, "lang string, x long, y long, value long")
    return values.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least_docs: int = 30, terms_to: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language
    by distance, part ``term`` the ``terms_to`` terms that the group has most above its language."""
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    # Terms in order of how many documents have them, so that zeros come to lie together.
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(kept, "kept-terms")
    held = counts.filter("term IS NOT NULL").join(kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(held, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.sum("total").alias("lang_total"))
    widths = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.max("docs").alias("most"))
    sizes = stored(sizes.join(widths, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long"))), "languages")

    spread = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / TERMS_IN_BUCKET))
    band = F.struct((-F.floor(F.log2(F.col("docs").cast("double")))).alias("band"), spread.alias("part"))
    columns = numbered(kept.join(sizes, "lang"), band, ["term"], "col")
    columns = stored(columns.select("lang", "term", "col", share("n", "lang_total", "terms").alias("q")), "columns")
    spread = F.pmod(F.xxhash64("source"), F.ceil(F.col("groups") / TERMS_IN_BUCKET))
    rows = numbered(groups.join(sizes, "lang"), spread, ["source"], "row")
    zero = rows.withColumn("none", F.lit(0).cast("long"))
    rows = stored(zero.select("lang", "source", "row", "total", "terms", share("none", "total", "terms").alias("zero")), "rows")

    cells = counts.filter("term IS NOT NULL").join(columns, ["lang", "term"]).join(rows, ["lang", "source"])
    cells = stored(cells.select("lang", "source", "term", "row", "col", "q", share("n", "total", "terms").alias("p")), "cells")

    apart = stored(pair_values(rows, cells.select("lang", "row", "col", "p"), sizes), "pairs")
    names = rows.select("lang", "row", "source")
    apart = apart.join(names.select("lang", F.col("row").alias("x"), F.col("source").alias("one")), ["lang", "x"])
    apart = apart.join(names.select("lang", F.col("row").alias("y"), F.col("source").alias("other")), ["lang", "y"])
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item"))))
    apart = apart.select("lang", both.alias("ends"), "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    above = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms_to)
    return apart.withColumn("rank", F.row_number().over(order)).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
