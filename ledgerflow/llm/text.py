"""Vectorised handling of whole texts inside Arrow batches.

A batch is cut into runs of whole rows of about half a MB, so that the numpy columns made for
a run stay small whatever the batch or partition size. A single longer text forms a run
of its own; nothing is ever cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 500_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(0x5EED)
MIXED = _rng.integers(0, 2**64, 256, np.uint64)
LOWERED = np.arange(256)
LOWERED[65:91] += 32
MIXED_LOWER = MIXED[LOWERED]
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
UNBASE = pow(BASE, -1, 2**64)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""

    def made(size: int, base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    if n > RUN_BYTES + 65_536:  # a text longer than a run; its powers go with it
        return made(n, BASE), made(n, UNBASE)
    if not _powers:
        _powers.update(up=made(RUN_BYTES + 65_536, BASE), down=made(RUN_BYTES + 65_536, UNBASE))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(batch: pa.RecordBatch, column: str, limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive rows of about ``limit`` bytes; null reads as empty."""
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start), data[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and one past the last) of the runs of bytes that are no gap."""
    gap = gaps[data]
    before = np.empty(len(gap), bool)
    before[1:] = gap[:-1]
    after = np.empty(len(gap), bool)
    after[:-1] = gap[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = MIXED) -> np.ndarray:
    """A 64-bit hash of each span's bytes, read through ``table``, wherever the span lies."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all ``n`` consecutive words of each row; a row of fewer words gives its whole sequence."""
    many = np.diff(first)
    rows = np.repeat(np.arange(len(many)), np.where(many >= n, many - n + 1, (many > 0).astype(many.dtype)))
    begin = np.cumsum(np.where(many >= n, many - n + 1, (many > 0).astype(many.dtype)))
    at = first[rows] + np.arange(len(rows)) - np.concatenate([[0], begin])[rows]
    have = np.minimum(many, n)[rows]
    out = np.full(len(rows), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(n):
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(k < have, mix(out * np.uint64(BASE) + word), out)
    return out, rows
