"""Vectorised text handling over Arrow string columns: bytes, words, hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; every step works on the
UTF-8 bytes of many documents at once, in pieces of about 1 MB (a single longer
document is a piece of its own), so memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Finds and hashes the words of a piece: ``start``, ``end`` (byte positions), ``hash``; ``first[d]`` is the number of words before document d."""

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.black = np.ones(256, bool)
        self.black[[9, 10, 11, 12, 13, 32]] = False
        self.values = constants(256, 7)[self.lower]
        self.base = U64(0x9E3779B97F4A7C15) | U64(1)
        inverse = pow(int(self.base), -1, 1 << 64)
        self.inverse = U64(inverse)
        self.up = self.down = np.zeros(0, U64)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> "Words":
        n = len(buf)
        black = self.black[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        new = black.copy()
        new[1:] &= ~black[:-1] | edge[1:n]
        last = black
        last[:-1] &= ~black[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(new), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        if n > len(self.up):
            self.up = np.cumprod(np.full(n, self.base, U64))
            self.down = np.cumprod(np.full(n, self.inverse, U64))
        total = np.zeros(n + 1, U64)
        np.cumsum(self.values[buf] * self.up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * self.down[self.start] if n else np.zeros(0, U64))
        return self


def ngrams(h: np.ndarray, first: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a document, and the index of the first word of each."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m, k = len(h) - n + 1, constants(n, seed)
    out = h[:m] * k[0]
    for i in range(1, n):
        out += h[i : i + m] * k[i]
    inside = np.ones(len(h), bool)
    for i in range(1, n):
        at = first[1:] - i
        inside[at[at >= 0]] = False  # what starts fewer than n words before an end crosses it
    # an end nearer than n to an earlier document's start only marks more of words that cross as well
    at = np.flatnonzero(inside[:m])
    return mix(out[at]), at


def owner(first: np.ndarray) -> np.ndarray:
    """The document of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
