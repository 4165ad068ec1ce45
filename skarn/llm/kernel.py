"""Vectorised kernels over UTF-8 text in Arrow batches. Words are [^\\x20\\x09-\\x0D]+."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_TABLE = np.random.default_rng(0x5EED).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _BASE_INV)):
            a = np.full(max(n, 1 << 21), b, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of every document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1] | space[1:]  # a boundary lies before byte i
    edge[1:-1] &= space[:-1] != space[1:]
    edge[offsets] = True
    word = ~space
    starts = np.flatnonzero(word & edge[:-1])
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, wherever it lies."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, the document and the first word of each."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(hashes) - k + 1)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :][:n]) if n else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * _M3 + hashes[at + i]
    return mix(h), doc[at], at


def whole_or_shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of every document, sorted by document; a shorter document's only one is its whole text."""
    h, doc, _ = shingles(hashes, counts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])[short]
        w = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            w[has] = w[has] * _M3 + hashes[begin[has] + i]
        w = mix(w + np.uint64(0xA5A5) + counts[short].astype(np.uint64) * _M2)
        h, doc = np.concatenate([h, w]), np.concatenate([doc, short])
    if len(h) == 0:
        return h, doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], doc[first]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other letters stay."""
    return LOWER[data]
