"""Byte-pair encoding and decoding with a public vocabulary file.

Encoding keeps the symbols of a word in a doubly linked list and the applicable merges in
a priority queue of (rank, place); an entry whose symbols have changed since it was queued
is skipped when it comes up. Decoding concatenates vocabulary strings. Null texts count as
empty; repeated rows are encoded like any other; extra columns are kept unless ``encoded``
is asked for its own columns only.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_BYTES = 96_000_000  # of words and stretches already encoded, per task
ENTRY_BYTES = 150
SEPARATORS = re.compile("[\x1c-\x1f]").search
WHITE = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A lower-casing word-end BPE vocabulary as its ``tokenizers`` JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.ids.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.ids[a]][self.ids[b]] = rank
        self.made = [self.ids[a + b] for a, b in pairs]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.symbols = byte_symbols()
        self.single = [self.ids.get(s) for s in self.symbols]
        self.last = [self.ids.get(s + self.end) for s in self.symbols]
        # Ids as little-endian 32-bit integers. Words that encode alike as a stretch of their
        # own are kept as stretches only; ``older`` holds what the half before this one did.
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.young = self.held = 0

    def forget(self) -> None:
        """Empty the caches; a task does so at its end, so a worker holds the vocabulary only."""
        self.chunks.clear()
        self.words.clear()
        self.older = {}, {}
        self.young = self.held = 0

    def keep(self, cache: dict[str, bytes], text: str, made: bytes) -> None:
        """Once half of the room is filled the other half is given up, but for what was asked
        for again meanwhile."""
        size = ENTRY_BYTES + 3 * len(text) + len(made)
        if size > CACHE_BYTES // 64:  # a long stretch hardly comes again
            return
        cache[text] = made
        self.young += size
        self.held += size
        if self.young > CACHE_BYTES // 2 - CACHE_BYTES // 64:
            self.older = self.chunks.copy(), self.words.copy()
            self.chunks.clear()  # in place: ``parts`` has its lookup bound
            self.words.clear()
            self.young, self.held = 0, self.young

    def merged(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode()
        sym = [self.single[b] for b in data]
        sym[-1] = self.last[data[-1]]
        n, ranks, made = len(sym), self.ranks, self.made
        # An entry holds the rank above the place, so the queue compares plain integers.
        shift = 14 if n < 16_384 else 40
        place = (1 << shift) - 1
        queue = [r << shift | i for i, (a, b) in enumerate(pairwise(sym)) if (r := ranks[a].get(b)) is not None]
        if not queue:
            return sym
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & place
            left, j = sym[i], after[i]
            if left < 0 or j >= n or ranks[left].get(sym[j]) != entry >> shift:
                continue  # stale: a neighbour was merged in the meantime
            new = sym[i] = made[entry >> shift]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks[new].get(sym[k])) is not None:
                    heappush(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := ranks[sym[h]].get(new)) is not None:
                heappush(queue, r << shift | h)
        return [s for s in sym if s >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian 32-bit integers."""
        # Letters that normalising leaves alone are one word as a stretch, too.
        k = 0 if word.isalpha() and (word.isascii() or self.normalised(word) == word) else 1
        cache = (self.chunks, self.words)[k]
        if (out := cache.get(word)) is None:
            out = self.older[k].get(word) or array("I", self.merged(word)).tobytes()
            self.keep(cache, word, out)
        return out

    def chunk(self, chunk: str) -> bytes:
        """Like ``word`` for a stretch without white space, special tokens included."""
        if (made := self.older[0].get(chunk)) is None:
            if "<|" in chunk:
                made = b"".join([
                    array("I", [self.special[piece]]).tobytes() if piece in self.special else self.plain(piece)
                    for piece in self.specials(chunk)
                ])
            else:
                made = self.plain(chunk)
        if chunk not in self.chunks:
            self.keep(self.chunks, chunk, made)
        return made

    def plain(self, piece: str) -> bytes:
        """Like ``chunk`` where no special token occurs."""
        text = self.normalised(piece)
        return self.word(text) if text.isalpha() else b"".join(map(self.word, self.pieces(text)))

    def normalised(self, text: str) -> str:
        """NFC, then lower case character by character (no rule for a final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> list[bytes]:
        """The ids of a text's stretches in order; no piece spans white space."""
        if SEPARATORS(text):  # white space to str.split, ordinary characters to the vocabulary
            chunks = WHITE.split(text)
        else:
            chunks = text.split()
        get, chunk = self.chunks.get, self.chunk
        return [get(c) or chunk(c) for c in chunks]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after another, parted by a space as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)


@contextmanager
def in_task(path: str) -> Iterator[WordBPE]:
    """The vocabulary, with caches that end with the task."""
    bpe = loaded(path)
    try:
        yield bpe
    finally:
        bpe.forget()


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids per row; one pass, no shuffle."""
    schema = docs.select("*", F.array(F.lit(0)).alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist()
                    rows = [np.frombuffer(b"".join(bpe.parts(t)), "<i4") for t in texts]
                    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of token ids per row, null where the ids are null; one
    pass, no shuffle. Ids that the vocabulary lacks raise KeyError."""
    schema = docs.select("*", F.lit(None).cast("string").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(path) as bpe:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    rows = batch.column(batch.schema.get_field_index(ids))
                    made = [None if not r.is_valid else bpe.decode(np.asarray(r.values).tolist()) for r in rows]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text per row, for comparing round trips."""
    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        with in_task(path) as bpe:
            for batch in batches:
                counts, ids, shown = [], [], []
                for value in batch.column(1):
                    data = b"".join(bpe.parts(value.as_py() or ""))
                    counts.append(len(data) // 4)
                    ids.append(sha(data).hexdigest())
                    shown.append(sha(bpe.decode(np.frombuffer(data, "<u4").tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)
