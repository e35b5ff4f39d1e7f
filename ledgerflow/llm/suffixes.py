"""Removal of repeated byte strings by suffix arrays built with a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier, in a
document with a smaller id or before it in the same one. Matches never cross documents and
are judged on the input.

The suffixes are dealt to bins so that equal strings of ``length`` bytes meet: each string
goes by the smallest hash among its windows of ``GRAM`` bytes (its anchor), and consecutive
starts with the same anchor travel as one segment of text. Segments whose anchor occurs in
one text only, and once, hold no repeat and are dropped before any text moves. Equal segments
count once, by their earliest place, so a passage that a third of all documents share is one
row. Inside a bin the suffix array is made by the difference cover of period three: name the
triples at two thirds of the places, recurse on the names until they differ, sort the
remaining suffixes by one byte and a rank, merge, and compare the neighbours' prefixes.
An anchor with more than ``CROWDED`` different segments would fill one bin; its strings are
dealt one by one over all tasks by a 128-bit digest instead.

Null texts are empty. Whole copies of an earlier document are removed as a whole. Repeated
rows of one id are each judged by themselves: a string at the same place of a row with the
same id is not earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.tables import release, stored
from ledgerflow.llm.text import MIXED, mix, powers, runs

LENGTH = 100
GRAM = 20
CROWDED = 4_000
CHUNK_BYTES = 500_000
PLACES = 2**26 - 1
PIECE = 2**25
SEGMENT = "anchor long, doc_id long, version long, start int, starts int, bytes binary, inner boolean"


# --- Suffix array by a difference cover of period three ---


def sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their keys, the keys in order).

    Where key and place fit one number, plain sorting of numbers is several times faster.
    """
    bits = max(len(key) - 1, 1).bit_length()
    if int(key.max(initial=0)).bit_length() + bits <= 63:
        both = np.sort(key << bits | np.arange(len(key)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key)
    return order, key[order]


def names_of(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks, from 1, of the rows over the columns, and how many differ."""
    ranks = columns[0].astype(np.int64)
    for n, column in enumerate(columns[1:], 2):
        ranks = ranks * (int(column.max(initial=0)) + 1) + column
        if n < len(columns) and int(ranks.max(initial=0)).bit_length() + len(ranks).bit_length() < 40:
            continue  # the next column still fits beside it
        order, keys = sorted_places(ranks)
        ranks[order] = np.cumsum(np.concatenate([[1], keys[1:] != keys[:-1]])) if len(keys) else keys
    return ranks, int(ranks.max(initial=0))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``s`` (whole numbers from 1) in lexicographic order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), [0, 0, 0]])
    n1 = (n + 1) // 3 + (n % 3 == 1)  # one dummy suffix keeps the two sampled parts apart
    ones = np.arange(n1) * 3 + 1
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, many = names_of(t[sample], t[np.minimum(sample + 1, n + 2)], t[np.minimum(sample + 2, n + 2)])
    if many < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(names), np.int64)
        order[names - 1] = np.arange(len(names))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    wide = len(sample) + 2
    zero_key = t[zeros] * wide + rank[zeros + 1]
    zeros = zeros[sorted_places(zero_key)[0]]
    # A remaining suffix meets a sampled one by one symbol and a rank, or by two and a rank.
    of_one = sampled[sampled % 3 == 1]
    before = np.searchsorted(t[of_one] * wide + rank[of_one + 1], t[zeros] * wide + rank[zeros + 1])
    of_two = sampled[sampled % 3 == 2]
    pairs, _ = names_of(np.concatenate([t[of_two], t[zeros]]), np.concatenate([t[of_two + 1], t[zeros + 1]]))
    left, right = pairs[: len(of_two)], pairs[len(of_two) :]
    before += np.searchsorted(left * wide + rank[of_two + 2], right * wide + rank[zeros + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zeros))
    out[place] = zeros
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def equal_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffix at each place of ``order`` begins with the same ``length`` bytes as the one before."""
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    if length >= 8:
        wide = np.zeros(len(data) - 7, np.uint64)
        for k in range(8):
            wide |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        steps = [*range(0, length - 7, 8), length - 8]
    else:
        wide, steps = data, range(length)
    open_ = np.arange(1, len(order))
    for k in steps:  # most neighbours differ early and leave
        open_ = open_[wide[order[open_] + k] == wide[order[open_ - 1] + k]]
    same[open_] = True
    return same


# --- Segments ---


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts, whether the anchor occurs in it repeatedly)
    of the maximal runs of starts with one anchor, over all rows; starts that do not leave
    ``length`` bytes in their row are left out."""
    parts = []
    for cut in range(0, max(len(data) - length + 1, 0), PIECE):  # places must fit below the hashes
        stop = min(len(data), cut + PIECE + length - 1)
        inside = np.ones(stop - cut - length + 1, np.int8)
        rows = offsets[(offsets > cut) & (offsets < stop)] - cut
        for end in rows:
            inside[max(0, end - length + 1) : end] = 0
        hashes, first, many, again = _anchored(data[cut:stop], inside, rows, length)
        parts.append((hashes, first + cut, many, again))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchored(data: np.ndarray, inside: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    gram = min(GRAM, length)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(MIXED[data] * up[: len(data)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    # Of equal hashes in a window the first counts: its place is the low part of what is compared.
    low = (grams & ~np.uint64(PLACES)) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: size - width], low[width - size :])
    place = (low & np.uint64(PLACES)).astype(np.int64)
    anchor = grams[place]
    change = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    change[rows[rows < len(anchor)] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], change]))
    many = np.diff(np.append(first, len(anchor)))
    keep = inside[first] == 1
    first, many = first[keep], many[keep]
    return anchor[first].view(np.int64), first, many, place[first] != place[first + many - 1]


def anchors(texts: DataFrame, length: int, places: bool) -> DataFrame:
    """(anchor, version, again) per text and distinct anchor, or (anchor, doc_id, nth) per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                hashes, first, _, inner = anchored(data, offsets, length)
                row = np.searchsorted(offsets, first, "right") - 1
                if places:
                    nth = np.arange(len(row)) - np.searchsorted(row, row)
                    ids = rows.column(0).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), ids, pa.array(nth, pa.int32())], names=["anchor", "doc_id", "nth"])
                    continue
                order = np.lexsort((hashes, row))
                hashes, row, inner = hashes[order], row[order], inner[order]
                new = np.ones(len(row), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                again = (np.diff(np.append(at, len(row))) > 1) | inner[at]
                version = rows.column(1).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at], pa.int64()), version, pa.array(again, pa.bool_())], names=["anchor", "version", "again"])

    schema = "anchor long, doc_id long, nth int" if places else "anchor long, version long, again boolean"
    return texts.mapInArrow(run, schema)


def segments(chosen: DataFrame, length: int) -> DataFrame:
    """The segments named in ``nth`` of each (doc_id, version, text, nth) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch, "text"):
                hashes, first, many, inner = anchored(data, offsets, length)
                row = np.searchsorted(offsets, first, "right") - 1
                begin = np.searchsorted(row, np.arange(rows.num_rows))
                ends, flat = np.asarray(rows.column(3).offsets), np.asarray(rows.column(3).values)
                # Another text of a repeated id may have had more segments than this one.
                pick = [b + (x := flat[p:q])[x < e - b] for p, q, b, e in zip(ends[:-1], ends[1:], begin, np.append(begin[1:], len(row)), strict=True)]
                pick = np.unique(np.concatenate(pick)).astype(np.int64)
                raw = data.tobytes()
                bodies = [raw[a : a + m + length - 1] for a, m in zip(first[pick].tolist(), many[pick].tolist(), strict=True)]
                at = pa.array(row[pick])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[pick], pa.int64()),
                        rows.column(0).take(at),
                        rows.column(1).take(at),
                        pa.array(first[pick] - offsets[row[pick]], pa.int32()),
                        pa.array(many[pick], pa.int32()),
                        pa.array(bodies, pa.binary()),
                        pa.array(inner[pick], pa.bool_()),
                    ],
                    names=["anchor", "doc_id", "version", "start", "starts", "bytes", "inner"],
                )

    return chosen.mapInArrow(run, SEGMENT)


def repeated_starts(bins: DataFrame, length: int) -> DataFrame:
    """(doc_id, version, start, starts): runs of starts whose string also starts earlier, from
    partitions that hold all segments of their anchors, sorted by anchor."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        doc, version, start, starts = (np.asarray(rows.column(c)) for c in ("doc_id", "version", "start", "starts"))
        bodies = rows.column("bytes").to_pylist()
        data = np.frombuffer(b"\0".join(bodies), np.uint8)
        sizes = np.array([len(b) + 1 for b in bodies])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(bodies)), sizes)[: len(data)]
        shift = np.arange(len(data)) - begin[owner]
        order = suffix_array(data.astype(np.int64) + 1)
        order = order[shift[order] < starts[owner[order]]]
        group = np.cumsum(~equal_prefixes(data, order, length))
        seg, off = owner[order], shift[order]
        at = start[seg] + off
        by = np.lexsort((at, doc[seg], group))
        group, seg, off, at = group[by], seg[by], off[by], at[by]
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        lead_at = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
        hit = (doc[seg] != doc[seg[lead_at]]) | (at != at[lead_at])
        flagged = np.sort(begin[seg[hit]] + off[hit])
        cut = np.concatenate([[True], np.diff(flagged) > 1]) if len(flagged) else np.zeros(0, bool)
        head = np.flatnonzero(cut)
        many = np.diff(np.append(head, len(flagged)))
        seg = owner[flagged[head]]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[seg]), pa.array(version[seg]), pa.array(start[seg] + shift[flagged[head]], pa.int32()), pa.array(many, pa.int32())],
            names=["doc_id", "version", "start", "starts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            keys = np.asarray(whole.column(0))
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                if size > CHUNK_BYTES and np.asarray(held[-1].column(0))[-1] != keys[a]:
                    yield flush(held)
                    held, size = [], 0
                held.append(whole.slice(a, b - a))
                size += held[-1].column(5).nbytes
        if held:
            yield flush(held)

    return bins.mapInArrow(run, "doc_id long, version long, start int, starts int")


def single_strings(crowded: DataFrame, length: int) -> DataFrame:
    """(digest, doc_id, version, at) for each string of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                rows = whole.slice(a, 512)
                starts = np.asarray(rows.column(4))
                owner = np.repeat(np.arange(rows.num_rows), starts)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
                bodies = rows.column(5).to_pylist()
                digest = [hashlib.blake2b(bodies[o][k : k + length], digest_size=16).digest() for o, k in zip(owner.tolist(), at.tolist(), strict=True)]
                of = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), rows.column(1).take(of), rows.column(2).take(of), pa.array(np.asarray(rows.column(3))[owner] + at, pa.int32())],
                    names=["digest", "doc_id", "version", "at"],
                )

    return crowded.mapInArrow(run, "digest binary, doc_id long, version long, at int")


# --- The whole table ---


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, version, start, starts): all runs of starts whose string also starts earlier,
    whole copies aside; ``texts`` has doc_id, version (a hash of the text) and text."""
    seen = anchors(texts.select("doc_id", "version", "text"), length, False)
    doubled = seen.groupBy("anchor").agg(F.min("version").alias("v1"), F.max("version").alias("v2"), F.max("again").alias("again"))
    doubled = stored(doubled.filter("v1 <> v2 or again").select("anchor"), "anchors")
    places = anchors(texts.select("doc_id", "version", "text"), length, True)
    chosen = stored(places.join(doubled, "anchor").groupBy("doc_id").agg(F.collect_set("nth").alias("nth")), "places")
    release(texts.sparkSession)
    found = stored(segments(texts.join(chosen, "doc_id").select("doc_id", "version", "text", "nth"), length), "segments")
    release(texts.sparkSession)

    # Equal segments: all but the earliest are repeats from their first string to their last.
    key = found.withColumn("digest", F.unhex(F.md5("bytes")))
    place = F.struct("doc_id", "start", "version")
    earliest = key.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    earliest = stored(earliest, "earliest")
    copied = key.select("digest", "doc_id", "version", "start", "starts").join(earliest.filter("copies > 1").select("digest", "first"), "digest")
    copied = copied.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).select("doc_id", "version", "start", "starts")
    once = (
        key.join(earliest.select("digest", "first"), "digest")
        .filter((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("version") == F.col("first.version")))
        .select("anchor", "doc_id", "version", "start", "starts", "bytes", "inner")
    )
    once = stored(once, "distinct")
    release(texts.sparkSession)
    many = once.groupBy("anchor").agg(F.count("*").alias("c"), F.max("inner").alias("inner"))
    alone, shared, crowded = (F.col("c") == 1) & ~F.col("inner"), F.col("c") <= CROWDED, F.col("c") > CROWDED
    many = stored(many.filter(~alone), "crowds")
    bins = once.join(many.filter(shared).select("anchor"), "anchor", "left_semi").repartition("anchor").sortWithinPartitions("anchor")
    inside = repeated_starts(bins.select("anchor", "doc_id", "version", "start", "starts", "bytes"), length)
    strings = single_strings(once.join(many.filter(crowded).select("anchor"), "anchor", "left_semi").select("anchor", "doc_id", "version", "start", "starts", "bytes"), length)
    first = strings.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    outside = (
        strings.join(first, "digest")
        .filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
        .select("doc_id", "version", F.col("at").alias("start"), F.lit(1).alias("starts"))
    )
    return stored(copied.unionByName(inside).unionByName(outside), "repeats")


def with_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text, whole, spans): every row, as it was in ``row``, with its repeats as
    byte runs [begin, end); ``whole`` says that it is a copy of an earlier document of at least
    ``length`` bytes."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    texts = docs.select(rest, F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("text"))
    spans = repeats(texts, length).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("starts") + (length - 1)).alias("end"))).alias("spans"))
    digest = texts.filter(F.octet_length("text") >= length).select("doc_id", "version", F.unhex(F.md5("text")).alias("digest"))
    firsts = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    copies = digest.join(firsts, "digest").filter("doc_id > first").select("doc_id", "version").distinct().withColumn("whole", F.lit(True))
    marks = stored(spans.join(copies, ["doc_id", "version"], "full_outer"), "marks")
    release(docs.sparkSession)
    return texts.join(marks, ["doc_id", "version"], "left").select("row", "doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


def removed_mask(size: int, whole: bool, spans: list | None) -> np.ndarray:
    """Which bytes go."""
    if whole:
        return np.ones(size, bool)
    change = np.zeros(size + 1, np.int64)
    for span in spans or ():
        change[span["start"]] += 1
        change[span["end"]] -= 1
    return np.cumsum(change)[:-1] > 0


def digests(docs: DataFrame, length: int = LENGTH, **columns: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, whole, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                if not whole and not spans.is_valid:
                    rows.append((doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                gone = removed_mask(len(data), whole, spans.as_py())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                count = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                rows.append((doc_id, len(data), int(gone.sum()), count, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = with_repeats(docs, length, **columns).select("doc_id", "text", "whole", "spans")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left of every text, and a column ``n_removed`` of the bytes cut out;
    a character that lost one of its bytes goes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone_bytes = [], []
            for body, whole, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = body.as_buffer().to_pybytes()
                gone = removed_mask(len(data), whole, spans.as_py() if spans.is_valid else None)
                gone_bytes.append(int(gone.sum()))
                texts.append(np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore") if gone_bytes[-1] else data.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone_bytes, pa.int64())], names=["row", "kept", "gone"])

    marked = with_repeats(docs, length, key, text).select("row", "text", "whole", "spans")
    made = marked.mapInArrow(run, f"row {marked.schema['row'].dataType.simpleString()}, kept string, gone long")
    columns = [F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "n_removed"]
    return made.select(*columns, F.col("gone").alias("n_removed"))
