"""Words and word hashes of Arrow text columns, for operators that read whole texts in Arrow batches.

All work is on numpy arrays over the UTF-8 bytes of a bounded slice of rows; a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text held in work arrays at a time; a single longer text is a slice of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Byte classes: words of non-blank bytes, and words of ASCII letters and digits and all other characters.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[9, 10, 11, 12, 13, 32]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[48:58] = LETTERS_DIGITS[65:91] = LETTERS_DIGITS[97:123] = LETTERS_DIGITS[128:] = True

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; NULL is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - int(offsets[0])


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words: runs of bytes of the class, never across rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, A-Z taken as a-z if ``lower``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64)
    inner = place - np.repeat(first, size)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()), _RADIX, np.uint64))))
    value = _BYTE_VALUE[_LOWER[data]] if lower else _BYTE_VALUE[data]
    value = value[np.repeat(start, size) + inner] * power[inner]
    return mix(np.add.reduceat(value, first) ^ size.astype(np.uint64))


def shingles(word_hash: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of k words; a row of fewer words, but not none, gives its whole sequence."""
    coef = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
    n = np.bincount(row, minlength=rows)
    parts, owner = [], []
    m = len(word_hash)
    if m >= k:
        total = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            total += word_hash[j:m - k + 1 + j] * coef[j]
        full = row[:m - k + 1] == row[k - 1:]
        parts.append(mix(total[full]))
        owner.append(row[:m - k + 1][full])
    short = np.flatnonzero((n > 0) & (n < k))
    first = np.cumsum(n) - n
    for size in range(1, k):
        at = short[n[short] == size]
        if len(at):
            total = np.full(len(at), size, np.uint64) * coef[k % 8]
            for j in range(size):
                total += word_hash[first[at] + j] * coef[j]
            parts.append(mix(total + coef[(k + 1) % 8]))
            owner.append(at)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owner)
