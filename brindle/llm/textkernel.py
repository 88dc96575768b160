"""Vectorised kernels over Arrow string buffers: words, word hashes and shingle hashes.

Everything works on raw UTF-8 bytes. A word of up to ``LONG_WORD`` bytes is hashed by a polynomial
over random 64-bit byte codes, read off a running sum; longer words by BLAKE2b. Temporary arrays
follow ``BLOCK`` bytes of text, not the size of a batch, so a very long text costs its own words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 3
_tables: dict[str, np.ndarray] = {}

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table() -> dict[str, np.ndarray]:
    if not _tables:
        base = np.uint64(_BASE & ~4 | 3)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _tables["code"] = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for name, b in (("pow", base), ("inv", inverse)):
            t = np.full(BLOCK + 1, b, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, ofs, data = column.buffers()
    offsets = np.frombuffer(ofs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    inside = _IS_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    t = _table()
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        first = starts[i]
        j = int(np.searchsorted(ends, first + BLOCK, "right"))
        if j == i:  # one word longer than a block
            i += 1
            continue
        part = data[first : ends[j - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(t["code"][part] * t["pow"][: len(part)], out=total[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (total[e] - total[s]) * t["inv"][s]
        i = j
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def _weights(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of h[i:i+k] for every i; rows are not told apart."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    w = _weights(k, seed)
    out = h[:m] * w[0]
    for i in range(1, k):
        out += h[i : i + m] * w[i]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row, joined, and where each row's begin.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    every = window_hashes(h, k)
    sets, at = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = window_hashes(h[a:b], b - a, seed=1000 + b - a)
        else:
            s = every[:0]
        sets.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(sets) if sets else every[:0]), np.array(at)
