"""Array-at-a-time tokenising and hashing of UTF-8 text for Arrow map stages.

Words are maximal runs of bytes of a class.  Both classes in use break only at
ASCII bytes, so working on bytes equals working on code points.  Hashes are
64 bits: two different strings of one run meet with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_SEED = 0x5EED
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    for low, high in separators:
        lut[low : high + 1] = False
    return lut


#: `[^\x20\x09-\x0D]+`
PLAIN = _class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text in lower case
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: A-Z to a-z, the rest as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 4 + 1 | 2
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)])) for b in (_BASE % 2**64, inverse)]
    return _powers[0], _powers[1]


def slices(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that `column` holds at most `limit` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of the rows of a string column, as flat arrays."""

    def __init__(self, column: pa.Array, kind: np.ndarray = PLAIN, lower: bool = False):
        data, rows = bytes_of(column)
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[rows] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = rows
        self.first = np.searchsorted(self.starts, rows)  # first word of each row, and the number of words
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self), dtype=np.uint64)
        at = 0
        while at < len(self):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.starts, low + CHUNK_BYTES)))
            high = self.ends[to - 1]
            up, down = _power_tables(int(high - low))
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * up[: high - low], out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD
            at = to
        return mix(out)

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """A hash of every k words in a row; those that cross rows mean nothing."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _ODD
            out += hashes[j : j + n]
        return mix(out)

    def within(self, k: int) -> np.ndarray:
        """True where k words from here are in one row."""
        n = len(self) - k + 1
        return self.row[:n] == self.row[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """For every `width` k-grams in a row, which of them (0..width-1) has the smallest hash, the last on ties."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, width):
        g = grams[j : j + n]
        less = g <= best
        at[less] = j
        np.minimum(best, g, out=best)
    return at
