"""Vectorised words, word hashes and window hashes over Arrow text columns (used inside tasks).

A batch is cut into slices of bounded bytes. Within a slice everything works on flat numpy arrays:
the UTF-8 bytes, the first byte and the end of each word, a 64-bit hash per word. A document longer
than the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_ODD_INV = np.uint64(pow(_ODD, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= _MULT
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _ODD, np.uint64)
        down = np.full(n, _ODD_INV, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(-(-int(n) // 131072) * 131072)    # few distinct sizes are kept
    return up[:n], down[:n]


def tidy(run: Callable) -> Callable:
    """The task function, which at its end gives freed memory back to the system: Spark keeps workers for
    later stages, and what they hold on to adds up beside the next stage's."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return wrapped


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'alnum' is [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing
    A-Z, 'space' is [^\\x20\\x09-\\x0D]. Bytes of characters beyond ASCII always do."""
    b = np.arange(256)
    if kind == "space":
        return (b != 0x20) & ~((b >= 9) & (b <= 13))
    lower = b | np.where((b >= 65) & (b <= 90), 32, 0)
    return (lower >= 0x80) | ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A))


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit number per byte; capitals get that of their small letter when ``lower``."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
    if lower:
        values[65:91] = values[97:123]
    return values


@dataclass
class Words:
    """Words of one slice of documents."""
    first_row: int          # index of the slice's first document in the batch
    data: np.ndarray        # bytes of the slice
    offsets: np.ndarray     # first byte of each document, and the end
    start: np.ndarray       # first byte of each word
    end: np.ndarray         # end of each word
    hash: np.ndarray        # 64-bit hash of each word
    bounds: np.ndarray      # first word of each document, and the end

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of documents of at most ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def words(column: pa.Array, kind: str, lower: bool, limit: int = SLICE_BYTES, hashed: bool = True) -> Iterator[Words]:
    """Words of a text column, slice by slice; without their hashes (zero) if they are not needed."""
    table, values = word_table(kind), byte_values(lower)
    for row, data, offsets in slices(column, limit):
        inside = table[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        start[heads] = inside[heads]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        tails = heads[heads > 0] - 1
        end[tails] = inside[tails]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        bounds = np.searchsorted(start, offsets)
        value = span_hash(values[data], start, end) if hashed else np.zeros(len(start), np.uint64)
        yield Words(row, data, offsets, start, end, value, bounds)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end] that depends on content and length alone."""
    with np.errstate(over="ignore"):
        up, down = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)


def window_hash(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k consecutive values, wherever it starts (document ends are not minded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hash(mix(hashes + np.uint64(seed)) if seed else hashes, at, at + k)


def starts_of_windows(bounds: np.ndarray, k: int) -> np.ndarray:
    """First words of all windows of k words that stay within one document."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    return ragged(bounds[:-1], count)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] numbers), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(np.asarray(first) - (ends - count), count)
