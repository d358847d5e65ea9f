"""Vectorised numpy kernels over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
SLICE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about so many bytes; a longer row is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(1 << bits, np.uint64), np.empty(1 << bits, np.uint64)
    with np.errstate(over="ignore"):
        for a, p in ((up, P), (down, P_INV)):
            a[0] = 1
            have, step = 1, p
            while have < len(a):
                a[have : 2 * have] = a[:have] * step
                have, step = 2 * have, step * step
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of P and of its inverse, n at least."""
    return _powers(max(20, (n + 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span."""
    up, down = powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows at[0]..at[-1]: hash, row, start and end of each word, a run of ASCII letters and digits in lower case and of bytes from 128."""
    base, n = int(at[0]), int(at[-1] - at[0])
    part = data[base : base + n]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[part]
    first = np.zeros(n + 1, bool)
    first[at - base] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    row = np.searchsorted(at - base, start, "right") - 1
    return span_hashes(_LOWER[part], start, end), row, start + base, end + base


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k consecutive words of a row; a row of fewer words has one shingle, of all of them."""
    n = len(h)
    if not n:
        return h, row
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    rows = np.concatenate([row, np.full(k, -1, row.dtype)])
    first = np.r_[True, row[1:] != row[:-1]]
    total, keep = np.zeros(n, np.uint64), first.copy()
    for i in range(k):
        same = rows[i : i + n] == row
        total = total * P + np.where(same, padded[i : i + n], np.uint64(0))
        if i == k - 1:
            keep |= same
    return mix(total[keep]), row[keep]
