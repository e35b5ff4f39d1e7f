"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits, A-Z in lower case. Items and documents are cut into
passages of ``PASSAGE`` words, every ``STRIDE`` words. The term weights are inverse document
frequencies counted over all documents; a randomised SVD of the items' TF-IDF passages, its
products summed over the cluster, gives the latent space: the leading directions, as few as leave
every passage of an item ``KEPT`` of its squared length, so no item is lost to the truncation.
Every passage of every document is projected, and pairs whose cosine reaches ``COSINE`` are
candidates: the product with the item's passage, that one of unit length in the space, by the
length of the document's passage before projection, where a repeated word counts as if it were
several, which only lets more pairs through. Words that no item has
count nothing in that cosine: with a weight of their own, as large as the number of documents
makes it, a short or reworded item would be lost among them the sooner the more documents
there are. A passage with fewer than ``LEAST_SHARED`` words of items is not compared,
unless an item is so repetitive that few different words can make up a match of it.

A candidate is settled on words: the longest common subsequence of the item and the document
around the passage must cover ``SHARE`` of the item within a stretch not much longer than the
item; from ``PARAPHRASE`` on, it is enough if the item's answer, its last sentence or at most
its last ``ANSWER_WORDS`` words, is there as well. Items of fewer than ``LEAST_WORDS`` words are
too short for that: they match where all their words, the answer's too, follow each other.

Items share a latent space with at most ``ITEMS_IN_SPACE`` others or so, which bounds the
dimensions, and a pass over the documents takes about
``ITEMS_AT_ONCE`` items: what is broadcast is bounded by constants and by the words of so many
items. Null and empty texts, and texts without a word, match nothing. Repeated documents are reported each; an item id that
repeats is reported once per text that matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.tables import stored
from ledgerflow.llm.text import MIXED_LOWER, runs, shingle_hashes, span_hashes, words
from ledgerflow.llm.toxicity import GAPS

PASSAGE = 24
STRIDE = 12
KEPT = 0.5
OVERSAMPLE = 16
POWER_STEPS = 3
COSINE = 0.4
SHARE = 0.8
PARAPHRASE = 0.6
STRETCH = 1.6
ANSWER_WORDS = 8
LEAST_WORDS = 8
LEAST_SHARED = 3
ITEMS_AT_ONCE = 1_000
ITEMS_IN_SPACE = 128
COLUMNS_AT_ONCE = 1_024
BLOCKS_AT_ONCE = 2_048

MATCH = "doc_id long, item_id long, share double, begin_word int, end_word int"


@dataclass
class Item:
    item_id: int
    grams: np.ndarray  # hashes of its words
    answer: int  # place of the first word of its answer


def item_of(item_id: int, text: str) -> Item:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]), GAPS)
    hashes = span_hashes(data, start, end, MIXED_LOWER)
    stops = [len(text[: m.start()].encode()) for m in re.finditer(r"[.!?]\s+\S", text)]
    last = int(np.searchsorted(start, stops[-1])) if stops else 0
    return Item(item_id, hashes, max(last, len(hashes) - ANSWER_WORDS, 0))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of one longest common subsequence."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        # The row's own prefix maximum stands for the step from the left.
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == a[i])))
    i, j, left, right = len(a), len(b), [], []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
    return np.array(left[::-1], int), np.array(right[::-1], int)


def settled(item: Item, text: np.ndarray, near: int) -> tuple[float, int, int] | None:
    """(share, begin, end) if the words around place ``near`` contain the item, else None."""
    size = len(item.grams)
    begin = max(0, near - size)
    around = text[begin : near + PASSAGE + size]
    small = size * len(around) <= 20_000
    there = (item.grams[:, None] == around).any(1) if small else np.isin(item.grams, around)
    if there.sum() < PARAPHRASE * size:
        return None
    left, right = common_subsequence(item.grams, around)
    best = None
    # The densest stretch: matched words scattered over more than the item's own length do not count.
    j = 0
    for i in range(len(right)):
        j = max(j, i)
        while j + 1 < len(right) and right[j + 1] - right[i] < STRETCH * size:
            j += 1
        if best is None or j - i > best[1] - best[0]:
            best = (i, j)
    if best is None:
        return None
    inside = left[best[0] : best[1] + 1]
    share = len(inside) / size
    answer = (inside >= item.answer).sum() / max(size - item.answer, 1)
    if share >= SHARE or (share >= PARAPHRASE and answer >= SHARE):
        return share, int(begin + right[best[0]]), int(begin + right[best[1]] + 1)
    return None


def different_words(item: Item) -> int:
    """How many different words a match of the item has at least."""
    times = np.sort(np.unique(item.grams, return_counts=True)[1])[::-1]
    return int(np.searchsorted(np.cumsum(times), PARAPHRASE * len(item.grams))) + 1


def short_matches(items: list[Item], hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Item, int]]:
    """(row, item, place) where all words of a short item follow each other, once for each row and item."""
    for size in sorted({len(i.grams) for i in items}):
        known: dict[int, list[Item]] = {}
        for item in (i for i in items if len(i.grams) == size):
            known.setdefault(int(shingle_hashes(item.grams, np.array([0, size]), size)[0][0]), []).append(item)
        found, rows = shingle_hashes(hashes, first, size)
        at = np.flatnonzero(np.isin(found, np.array(list(known), np.uint64)) & (np.diff(first)[rows] >= size))
        _, once = np.unique(np.stack([rows[at].astype(np.uint64), found[at]]), axis=1, return_index=True)
        for k in at[np.sort(once)]:
            for item in known[int(found[k])]:
                yield int(rows[k]), item, int(k - np.searchsorted(rows, rows[k]))


def windows(count: int) -> np.ndarray:
    """Begins of the passages of a text of ``count`` words; the last one may be shorter by less than a stride."""
    return np.arange(0, max(count - STRIDE, 1), STRIDE) if count else np.zeros(0, np.int64)


@dataclass
class Space:
    items: list[Item]
    vocabulary: np.ndarray  # sorted word hashes of the items
    weights: np.ndarray  # their inverse document frequencies
    basis: np.ndarray  # (vocabulary, rank)
    passages: np.ndarray  # (passages of items, rank), of unit length in the space
    owner: np.ndarray  # item of each passage
    least: int  # places with words of items that a passage must have

    def __post_init__(self):
        self.terms = (self.weights[:, None] * self.basis).astype(np.float32)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, place of the passage in its row, item)."""
        if not len(hashes) or not len(self.items):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        at = at[known].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(known)])
        mass = np.concatenate([[0.0], np.cumsum(self.weights[at] ** 2)])
        # A passage is two blocks of a stride, so each word is projected once; a text of one block is a passage.
        many = -(-np.diff(first) // STRIDE)
        row = np.repeat(np.arange(len(many)), many)
        block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        begin = first[row] + block * STRIDE
        low, high = upto[begin], upto[np.minimum(begin + STRIDE, first[row + 1])]
        follows = np.append(row[1:] == row[:-1], False)
        end = np.where(follows, np.append(high[1:], 0), high)
        likely = (follows | (block == 0)) & (end - low >= self.least)
        norm = np.sqrt(mass[end] - mass[low])
        room = np.empty((BLOCKS_AT_ONCE + 1, self.terms.shape[1]), np.float32)
        for a in range(0, len(row), BLOCKS_AT_ONCE):
            b = min(a + BLOCKS_AT_ONCE, len(row))
            c = min(b + 1, len(row))  # the last passage's other block
            held = high[a:c] - low[a:c]
            # Longest first, so the blocks that have a k-th word are the leading ones.
            order = np.argsort(-held, kind="stable")
            word, reach = low[a:c][order], np.searchsorted(-held[order], -np.arange(held.max()))
            sums = np.zeros((c - a, self.terms.shape[1]), np.float32)
            for k, upper in enumerate(reach):
                sums[:upper] += self.terms.take(at[word[:upper] + k], axis=0, out=room[:upper], mode="clip")
            summed = np.zeros((c - a + 1, self.terms.shape[1]), np.float32)
            summed[order] = sums
            part = np.flatnonzero(likely[a:b])
            query = summed[part] + np.where(follows[a + part][:, None], summed[part + 1], np.float32(0))
            for w, p in zip(*np.nonzero(query @ self.passages.T >= COSINE * norm[a + part][:, None]), strict=True):
                k = a + part[w]
                yield int(row[k]), int(block[k] * STRIDE), int(self.owner[p])


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = shared.value, 0
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                start, end, first = words(data, offsets, GAPS)
                hashes = span_hashes(data, start, end, MIXED_LOWER)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                row = np.repeat(np.arange(rows.num_rows), np.diff(first))[known]
                counts += np.bincount(np.unique(row * len(vocabulary) + at[known]) % len(vocabulary), minlength=len(vocabulary))
                total += rows.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["word", "c"])

    out = np.zeros(len(vocabulary), np.int64)
    n = 0
    # One row per word of the items at most comes back, whatever the number of documents.
    for r in docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).toLocalIterator():
        if r.word < 0:
            n = r.c
        else:
            out[r.word] = r.c
    return out, n


def latent_basis(passages: DataFrame, columns: int, rank: int) -> np.ndarray:
    """The first right singular vectors of the sparse rows (at, value), by randomised subspace
    iteration: every step is one product with the matrix and its transpose, formed where the
    rows lie and summed by blocks of columns."""
    width = min(rank + OVERSAMPLE, columns)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(columns, width)))[0]
    small = np.eye(width)
    for step in range(POWER_STEPS + 1):
        shared = passages.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            out = np.zeros_like(q)
            for batch in batches:
                for at, value in zip(batch.column(0), batch.column(1), strict=True):
                    at, value = np.asarray(at.values), np.asarray(value.values)
                    np.add.at(out, at, value[:, None] * (value @ q[at]))
            for block in range(0, len(q), COLUMNS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out[block : block + COLUMNS_AT_ONCE].tobytes()])], names=["block", "data"])

        def add(table: pa.Table) -> pa.Table:
            total = reduce(np.add, (np.frombuffer(d.as_buffer()) for d in table.column(1)))
            return pa.table({"block": table.column(0)[:1], "data": pa.array([total.tobytes()], pa.binary())})

        schema = "block long, data binary"
        rows = passages.select("at", "value").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()
        shared.destroy()  # else every step's copies stay on the driver until both its heaps are cleaned
        product = np.concatenate([np.frombuffer(r.data).reshape(-1, width) for r in sorted(rows, key=lambda r: r.block)])
        if step == POWER_STEPS:
            small = q.T @ product
        else:
            q = np.linalg.qr(product)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]])


def kept_rank(projected: np.ndarray) -> int:
    """The fewest leading dimensions that leave every passage ``KEPT`` of its squared length."""
    return int(np.argmax((projected**2).cumsum(1).min(0) >= KEPT)) + 1


def space_of(spark: SparkSession, items: list[Item], words_known: np.ndarray, counts: np.ndarray, n: int) -> Space:
    """The latent space of a block of items, with weights from the document frequencies of the known words."""
    vocabulary = np.unique(np.concatenate([i.grams for i in items]))
    counts = counts[np.searchsorted(words_known, vocabulary)]
    weights = np.log((n + 1) / (counts + 0.5)).clip(0.05)
    rows, owner = [], []
    for k, item in enumerate(items):
        at = np.searchsorted(vocabulary, item.grams)
        for b in windows(len(at)):
            part, times = np.unique(at[b : b + PASSAGE], return_counts=True)
            value = times * weights[part]
            rows.append((part, value / np.sqrt((value**2).sum())))
            owner.append(k)
    schema = "at array<long>, value array<double>"
    made = spark.createDataFrame([(a.tolist(), v.tolist()) for a, v in rows], schema).repartition(max(1, len(rows) // 2_000 + 1))
    basis = latent_basis(made, len(vocabulary), min(len(rows), len(vocabulary)))
    projected = np.stack([v @ basis[a] for a, v in rows])
    rank = kept_rank(projected)
    basis, projected = basis[:, :rank], projected[:, :rank]
    projected /= np.linalg.norm(projected, axis=1)[:, None]
    fewest = min(different_words(i) for i in items)
    least = LEAST_SHARED if fewest > LEAST_SHARED else 1
    return Space(items, vocabulary, weights, basis.astype(np.float32), projected.astype(np.float32), np.array(owner), least)


def matches_with(docs: DataFrame, spaces: list[Space], short: list[Item]) -> DataFrame:
    """(doc_id, item_id, share, begin_word, end_word): the best match of each document and item."""
    shared = docs.sparkSession.sparkContext.broadcast((spaces, short))
    names = ["doc_id", "item_id", "share", "begin_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                start, end, first = words(data, offsets, GAPS)
                hashes = span_hashes(data, start, end, MIXED_LOWER)
                ids, out = rows.column(0).to_pylist(), []
                spaces, short = shared.value
                for row, item, place in short_matches(short, hashes, first):
                    out.append((ids[row], item.item_id, 1.0, place, place + len(item.grams)))
                for space in spaces:
                    best: dict[tuple[int, int], tuple[float, int, int]] = {}
                    for row, near, k in space.candidates(hashes, first):
                        if (row, k) in best and best[row, k][0] >= 1:
                            continue  # settled already
                        found = settled(space.items[k], hashes[first[row] : first[row + 1]], near)
                        if found and found[0] > best.get((row, k), (0.0,))[0]:
                            best[row, k] = found
                    out += [(ids[r], space.items[k].item_id, *m) for (r, k), m in sorted(best.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, MATCH)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """All matches of benchmark items in documents; clean documents give no row."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    passes = max(1, -(-known.count() // ITEMS_AT_ONCE))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = []
    for k in range(passes):
        rows = known.filter(part == k).orderBy("item_id", "text").collect()
        made = [i for i in (item_of(r.item_id, r.text) for r in rows) if len(i.grams)]
        items, short = [i for i in made if len(i.grams) >= LEAST_WORDS], [i for i in made if len(i.grams) < LEAST_WORDS]
        if not items:
            if short:
                found.append(matches_with(plain, [], short))
            continue
        vocabulary = np.unique(np.concatenate([i.grams for i in items]))
        counts, n = document_frequencies(plain, vocabulary)
        blocks = -(-len(items) // ITEMS_IN_SPACE)
        found.append(matches_with(plain, [space_of(docs.sparkSession, items[b::blocks], vocabulary, counts, n) for b in range(blocks)], short))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCH)


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    The ids to leave out are stored first: their true size lets the planner spare the
    documents a shuffle where it is small."""
    dirty = stored(leaks(docs, benchmark, key=key, **columns).select(F.col("doc_id").alias(key)).distinct(), "dirty")
    return docs.join(dirty, key, "left_anti").select(*docs.columns)
