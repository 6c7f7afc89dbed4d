"""Vectorised word grids over Arrow text batches.

A grid is computed for a whole block of rows at once: one pass over the UTF-8
bytes finds the words, prefix sums give every word a position-independent
64-bit hash, and a second prefix sum gives every run of n words its hash.

Two word rules are used. ``ALNUM``: lower-cased runs of ASCII letters, digits
and any non-ASCII character. ``SOLID``: runs of bytes above the space (0x20),
case kept. A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F | 1
_QINV = pow(_Q, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
#: Bytes or words of a block that are in work at once: their sums take many times as much.
STEP = 1 << 17

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SOLID = np.zeros(256, bool)
SOLID[33:] = True

_tables: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
_handled = 0


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, U64)
        full[0] = 1
        have = _tables[base] = np.cumprod(full, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def large(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column if column.offset == 0 else pa.concat_arrays([column])


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` text bytes; a longer row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    tidy()


def tidy() -> None:
    """Give freed memory back, so that a worker that is used again doesn't keep what an earlier stage needed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def handled(n: int, every: int = 16 << 20) -> None:
    """tidy() whenever n and the bytes before it come to so many: for functions that are called once for each of many small groups."""
    global _handled
    _handled += n
    if _handled >= every:
        _handled = 0
        tidy()


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each row begins (one more entry at the end)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Grid:
    """Words of a block of rows: ``start``/``end`` byte positions, ``hash``, and ``row``: the first word of each row."""

    def __init__(self, column: pa.Array, table: np.ndarray = ALNUM, lower: bool = True):
        column = large(column)
        if lower:
            column = pc.utf8_lower(column)
        self.data, self.at = raw(column)
        mask = table[self.data]
        before, after = np.zeros_like(mask), np.zeros_like(mask)
        if len(mask):
            before[1:], after[:-1] = mask[:-1], mask[1:]
            before[self.at[:-1][self.at[:-1] < len(mask)]] = False
            after[self.at[1:] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.row = np.searchsorted(self.start, self.at)
        self.hash = self._words()

    def _words(self) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        first = 0
        while first < len(self.start):  # in steps, so that a huge row needs no huge table
            base = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.start, base + STEP)))
            s, e = self.start[first:last] - base, self.end[first:last] - base
            piece = self.data[base : base + e[-1]].astype(U64) + U64(1)
            total = np.zeros(len(piece) + 1, U64)
            np.cumsum(piece * _powers(_PINV, len(piece)), out=total[1:])
            out[first:last] = mix((total[e] - total[s]) * _powers(_P, len(piece) + 1)[e])
            first = last
        return out

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words that begin at each word, and whether the run stays in its row."""
        size = len(self.hash)
        if size < n:
            return np.zeros(size, U64), np.zeros(size, bool)
        if n <= 4:
            g = np.zeros(size - n + 1, U64)
            for k in range(n):
                g = g * U64(_Q) + self.hash[k : size - n + 1 + k]
            g = mix(g + U64(n))
        else:
            g = np.empty(size - n + 1, U64)
            for a in range(0, size - n + 1, BLOCK_BYTES):
                b = min(a + BLOCK_BYTES, size - n + 1)
                w = self.hash[a : b + n - 1]
                total = np.zeros(len(w) + 1, U64)
                np.cumsum(w * _powers(_QINV, len(w)), out=total[1:])
                g[a:b] = mix((total[n:] - total[:-n]) * _powers(_Q, len(w) + 1)[n:])
        out, ok = np.zeros(size, U64), np.zeros(size, bool)
        out[: len(g)] = g
        last = np.repeat(self.row[1:], np.diff(self.row)) - n  # the last start in each word's row
        ok[: len(g)] = np.arange(len(g)) <= last[: len(g)]
        return out, ok


def shingle_sets(grid: Grid, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-word shingle hashes; a row of fewer words is one shingle; no words, none."""
    g, _ = grid.ngrams(n)
    for a, b in zip(grid.row[:-1], grid.row[1:]):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            h = U64(b - a)
            for w in grid.hash[a:b]:
                h = U64((int(h) * _Q + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([h], U64))
        else:
            yield np.zeros(0, U64)
