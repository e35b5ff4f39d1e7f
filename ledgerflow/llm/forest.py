"""MinHash near-duplicates by an LSH forest: several sorted signature orders.

A tree of the forest sorts the documents by a signature of ``LEVELS`` min-hashes of their word
shingles. Documents that agree on the first ``SHALLOW`` of them form a region; inside it the order
goes on by the deeper ones, so those with the longest common prefix are neighbours. A region of
more than ``CROWD`` documents is cut deeper, at the next two min-hashes, then at all; where even
all agree, it is dealt at random. So the depth follows the crowd.

First turns: a document meets its next few neighbours of every tree and the middle of its region,
the document with the most usual deeper signature. Pairs that pass the sizes, the parities of
their sets (an exact bound, sharp for all but long texts) and a sketch of two bits per min-hash
are candidates; of a document's candidates the one met in most trees is verified
on whole sets, and what is linked counts as one from then on, so a turn asks only where components
still meet. Then, in the regions that still hold several components, every pair of different ones
meets: again the best of each document, in the last turn all that are left. A crowded region's documents outside its largest component meet all others in blocks, so
no task holds more than about two times ``CROWD`` of one region and no pair is left out. At the
threshold two documents share no region with probability (1 - s**4)**32, below 1e-7 at 0.8, and
the sketch turns away what is five standard deviations off.

Documents with the same shingle set are one class, by a 128-bit digest, and are settled by it.
Texts without words, null or empty, have an empty set and link with nothing; long texts are read
whole; repeated rows, also of one id, are members of classes like all others; a null id takes
part and never is a component's id, unless nothing else is; other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.components import components, extended
from ledgerflow.llm.ngram_join import parities, signed_sets
from ledgerflow.llm.tables import Scratch, stored
from ledgerflow.llm.text import mix, runs

TREES = 32
LEVELS = 8
SHALLOW = 4
NEIGHBOURS = 3
CROWD = 1_024
# Turns: who meets (neighbours, or all of a region that are still apart), and whether a document's
# best pair is enough. The last turn leaves nothing out.
TURNS = ((False, True), (True, True), (True, True), (True, False))
FUNCTIONS = TREES * LEVELS
SKETCH = [f"b{k}" for k in range(2 * FUNCTIONS // 64)]  # a bit of every min-hash, then another
PARITIES = [f"p{k}" for k in range(8)]  # 512 parities of the whole set
TRAITS = ["n", *SKETCH, *PARITIES]

_rng = np.random.default_rng(0xF0123)
LOW_FACTORS, HIGH_FACTORS = (_rng.integers(0, 2**31, FUNCTIONS, np.uint32) * 2 + 1 for _ in range(2))
TREE_MARKS = _rng.integers(0, 2**64, TREES, np.uint64)
SPREAD, LABEL = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)


def labels_of(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(functions, sets): 16 bits of each min-hash of the sets that start at ``first`` in ``flat``."""
    flat = flat.view(np.uint64)
    low, high = (flat & np.uint64(2**32 - 1)).astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((FUNCTIONS, len(first)), np.uint32)
    for k in range(FUNCTIONS):
        x = low * LOW_FACTORS[k]
        x += high * HIGH_FACTORS[k]
        x ^= x >> np.uint32(15)
        x *= SPREAD
        out[k] = np.minimum.reduceat(x, first)
    return (out * LABEL >> np.uint32(16)).astype(np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def packed(labels: np.ndarray) -> np.ndarray:
    """Levels side by side in one number, the first in the highest bits."""
    out = np.zeros(labels.shape[1:], np.uint64)
    for level in labels:
        out = out << np.uint64(16) | level
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, n, regions, deeper, sketch, parities) of (doc_id, text): set size, region and deeper signature per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                sets = signed_sets(data, offsets, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                regions, deeper = (np.zeros((len(sets), TREES), np.int64) for _ in range(2))
                sketch = np.zeros((len(sets), len(SKETCH)), np.int64)
                odd = np.array([parities(s) for s in sets])
                some = np.flatnonzero(sizes)
                if len(some):
                    made = labels_of(np.concatenate([sets[k] for k in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                    by_tree = made.reshape(TREES, LEVELS, -1).transpose(1, 0, 2)
                    regions[some] = signed(mix(packed(by_tree[:SHALLOW]) ^ TREE_MARKS[:, None]).T)
                    deeper[some] = signed(packed(by_tree[SHALLOW:]).T)
                    bits = np.concatenate([made >> np.uint64(b) & np.uint64(1) for b in (0, 1)]).astype(np.uint8)
                    sketch[some] = signed(np.packbits(bits.T, axis=1))
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TREES)
                lists = [pa.ListArray.from_arrays(ends, pa.array(m.ravel())) for m in (regions, deeper)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(digests, pa.binary()), pa.array(sizes), *lists, *map(pa.array, [*sketch.T.copy(), *odd.T.copy()])],
                    names=["doc_id", "digest", "n", "regions", "deeper", *SKETCH, *PARITIES],
                )

    columns = ", ".join(f"{b} long" for b in (*SKETCH, *PARITIES))
    return docs.mapInArrow(run, f"doc_id long, digest binary, n long, regions array<long>, deeper array<long>, {columns}")


def whole_sets(chosen: DataFrame, n: int) -> DataFrame:
    """(node, grams) of (node, digest, text). An id may repeat with another text; only the text of
    the digest counts, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                sets = signed_sets(data, offsets, n)
                own = [k for k, (d, s) in enumerate(zip(rows.column(1).to_pylist(), sets, strict=True)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]
                kept = [np.zeros(0, np.int64), *(sets[k] for k in own)]
                ends = np.cumsum([0, *map(len, kept[1:])], dtype=np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own, pa.int64())), grams], names=["node", "grams"])

    return chosen.select("node", "digest", "text").mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def middles(region: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """For sorted rows, the place of each one's region's middle: the first row of its longest run of equal deeper signatures."""
    new_region = np.concatenate([[True], region[1:] != region[:-1]])
    new_run = new_region | np.concatenate([[True], deeper[1:] != deeper[:-1]])
    starts = np.flatnonzero(new_run)
    length = np.diff(np.append(starts, len(region)))
    of_region = np.cumsum(new_region) - 1
    order = np.lexsort((starts, -length, of_region[starts]))
    best = starts[order][np.concatenate([[True], np.diff(of_region[starts][order]) > 0])]
    return best[of_region]


def met(percent: int, every: bool, best: bool):
    """Pairs (a, b) of different components among sorted rows of regions: neighbours and middles, or
    every pair; with ``best`` a row gives the pair of its most similar sketch only."""
    share = (1 - percent / 100) * 3 / 4
    limit = FUNCTIONS * share + 5 * np.sqrt(FUNCTIONS * share * (1 - share))
    half = len(SKETCH) // 2

    def pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        region, part, deeper, node, component, n = rows[:6]
        new = np.concatenate([[True], (region[1:] != region[:-1]) | (part[1:] != part[:-1])])
        group = np.cumsum(new)
        # Numpy counts the bits of a signed number's size.
        bits, odd = rows[6 : 6 + len(SKETCH)].view(np.uint64), rows[6 + len(SKETCH) :].view(np.uint64)
        out = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            fits = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            i, j = i[fits], j[fits]
            both = n[i] + n[j]
            most = both - 2 * -(-both * percent // (100 + percent))
            fits = np.bitwise_count(odd[:, i] ^ odd[:, j]).sum(0, dtype=np.int64) <= most
            i, j = i[fits], j[fits]
            differ = bits[:, i] ^ bits[:, j]
            apart = np.bitwise_count(differ[:half] | differ[half:]).sum(0, dtype=np.int64)
            near = apart <= limit
            out.append((i[near], j[near], apart[near]))

        at, lag = np.arange(len(node)), 1
        while every or lag <= NEIGHBOURS:
            at = at[at + lag < len(node)]
            at = at[group[at] == group[at + lag]]
            if not len(at):
                break
            keep(at, at + lag)
            lag += 1
        if not every:
            middle = middles(group, deeper)
            keep(np.flatnonzero(middle != np.arange(len(node))), middle[middle != np.arange(len(node))])
        i, j, apart = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        if best and len(i):
            row, other, apart = np.append(i, j), np.append(j, i), np.append(apart, apart)
            order = np.lexsort((other, apart, row))
            first = order[np.concatenate([[True], np.diff(row[order]) > 0])]
            i, j = row[first], other[first]
        a, b = node[i], node[j]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([np.asarray(c, np.int64) for c in batch.columns])
            held = rows if held is None else np.hstack([held, rows])
            # The last region may go on in the next batch.
            last = np.flatnonzero((held[:2] != held[:2, -1:]).any(0))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(held[:, :done])], names=["a", "b"])
                held = held[:, done:]
        if held is not None and held.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(held)], names=["a", "b"])

    return run


class Forest:
    def __init__(self, docs: DataFrame, n: int, percent: int, key: str, text: str):
        self.docs, self.n, self.percent = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), n, percent
        self.scratch = Scratch(docs.sparkSession)
        signed_rows = self.scratch.stored(signatures(self.docs, n), "signatures")
        self.rows = stored(signed_rows.select("doc_id", "digest", "n"), "rows")
        # One row per class; all its rows have the same signature.
        firsts = [F.first(c).alias(c) for c in ("regions", "deeper", *TRAITS)]
        classes = signed_rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *firsts)
        self.signed = self.scratch.stored(classes.withColumn("node", F.monotonically_increasing_id()), "signed-classes")
        self.classes = stored(self.signed.select("node", "digest", "doc_id"), "classes")
        self.traits = self.signed.select("node", *TRAITS)
        self.sets: DataFrame | None = None

    def places(self) -> DataFrame:
        """(region, deeper, node, size) of the regions that hold several classes."""
        placed = self.signed.select("node", F.explode(F.arrays_zip("regions", "deeper")).alias("p")).select("node", F.col("p.regions").alias("region"), F.col("p.deeper").alias("deeper"))
        crowds = placed.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
        return self.scratch.stored(placed.join(crowds, "region"), "places")

    def cut(self, placed: DataFrame) -> DataFrame:
        """``placed`` with the part of its region: crowded ones go deeper."""
        small = placed.filter(F.col("size") <= CROWD).withColumn("part", F.lit(0).cast("long"))
        large = placed.filter(F.col("size") > CROWD)
        if large.isEmpty():
            return small
        large = self.scratch.stored(large.withColumn("half", F.shiftright("deeper", 32)), "crowded")
        halves = large.groupBy("region", "half").agg(F.count("*").alias("of_half"))
        wholes = large.groupBy("region", "deeper").agg(F.count("*").alias("of_whole"))
        deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("of_whole") / CROWD))
        part = F.when(F.col("of_half") <= CROWD, F.xxhash64("half")).when(F.col("of_whole") <= CROWD, F.xxhash64("deeper")).otherwise(F.xxhash64("deeper", deal))
        large = large.join(halves, ["region", "half"]).join(wholes, ["region", "deeper"]).withColumn("part", part)
        return small.unionByName(large.select(small.columns))

    def blocks(self, placed: DataFrame) -> DataFrame:
        """``placed`` with the block of its region: all outside a crowded region's largest component meet all."""
        small = placed.filter(F.col("size") <= CROWD).withColumn("part", F.lit(0).cast("long"))
        large = placed.filter(F.col("size") > CROWD)
        if large.isEmpty():
            return small
        large = self.scratch.stored(large, "crowded")
        held = large.groupBy("region", "component").agg(F.count("*").alias("held"))
        tops = held.groupBy("region").agg(F.max_by("component", F.struct("held", "component")).alias("top"), F.max("held").alias("held"))
        large = large.join(tops, "region").withColumn("minors", F.ceil((F.col("size") - F.col("held")) / CROWD)).withColumn("alls", F.ceil(F.col("size") / CROWD))
        row = F.pmod(F.xxhash64("node", F.lit(1)), "minors")
        column = F.pmod(F.xxhash64("node"), "alls")
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
        asked = F.when(F.col("component") != F.col("top"), F.transform(upto("alls"), lambda c: F.xxhash64(row, c))).otherwise(F.array().cast("array<long>"))
        large = large.withColumn("part", F.explode(F.array_distinct(F.concat(F.transform(upto("minors"), lambda r: F.xxhash64(r, column)), asked))))
        return small.unionByName(large.select(small.columns))

    def candidates(self, places: DataFrame, found: DataFrame | None, tested: DataFrame | None, every: bool, best: bool) -> DataFrame:
        """(a, b): untested pairs of different components that meet in a region; with ``best`` for
        each document the one it meets in most trees."""
        if found is None:
            placed = places.withColumn("component", F.col("node"))
        else:
            placed = places.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = placed.groupBy("region").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("region")
            placed = placed.join(mixed, "region")
        placed = self.blocks(placed) if every else self.cut(placed)
        rows = placed.join(self.traits, "node").select("region", "part", "deeper", "node", "component", *TRAITS)
        rows = rows.repartition("region", "part").sortWithinPartitions("region", "part", "deeper", F.xxhash64("node"))
        pairs = rows.mapInArrow(met(self.percent, every, best), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("trees"))
        if best:  # links that reach are enough, the rest can wait
            if tested is not None:
                pairs = pairs.unionByName(tested.withColumn("trees", F.lit(None).cast("long"))).groupBy("a", "b").agg(F.max("trees").alias("trees"), F.count_if(F.col("trees").isNull()).alias("old"))
                pairs = pairs.filter("old = 0")
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("trees", F.xxhash64("a", "b").alias("h"), "a", "b").alias("pair"))
            pairs = ends.groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()
        elif tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        return self.scratch.stored(pairs.select("a", "b"), "candidates")

    def know(self, pairs: DataFrame) -> None:
        """Have the whole sets of all classes in ``pairs`` at hand."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        of = self.classes.join(wanted, "node").withColumnRenamed("doc_id", "of_id")
        more = self.docs.join(of, F.col("doc_id").eqNullSafe(F.col("of_id")))
        more = self.scratch.stored(whole_sets(more, self.n), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough, as edges (u, v)."""
        one = self.sets.select(F.col("node").alias("a"), F.col("grams").alias("g"))
        other = self.sets.select(F.col("node").alias("b"), F.col("grams").alias("h"))
        shared = F.size(F.array_intersect("g", "h")).cast("long")
        both = pairs.select("a", "b").join(one, "a").join(other, "b")
        links = both.filter(shared * 100 >= (F.size("g") + F.size("h") - shared) * self.percent)
        return self.scratch.stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    def components(self) -> DataFrame:
        """(node, component) for every class that links with another."""
        places = self.places()
        found = tested = None
        for every, best in TURNS:
            chosen = self.candidates(places, found, tested, every, best)
            if chosen.isEmpty():
                continue
            self.know(chosen)
            links = self.verified(chosen)
            tested = chosen if tested is None else tested.unionByName(chosen)
            if not links.isEmpty():
                found = self.scratch.stored(components(links) if found is None else extended(found, links), "components")
        if found is None:
            found = self.classes.limit(0).select("node", F.col("node").alias("component"))
        found = stored(found, "components")
        self.scratch.clear()
        return found


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: the size of its set, the smallest id
    reachable over links of at least ``percent`` Jaccard similarity, and whether that is its own."""
    forest = Forest(docs, n, percent, key, text)
    found = forest.components()
    named = forest.classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    least = named.join(least, "component").select("digest", "least")
    made = forest.rows.join(least, "digest", "left")
    made = made.withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return made.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
