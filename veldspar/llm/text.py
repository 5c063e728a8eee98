"""Words and n-grams of whole Arrow columns, computed with numpy on the UTF-8 bytes.

A column is cut at document borders into slices of a few megabytes; a text longer than that is a slice of its own.
Hashes are 64 bit and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# Word bytes: digits, letters (A-Z counts as a-z) and everything that is not ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_2 = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of a 64-bit mixing hash)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any substrings of ``data`` from one prefix sum modulo 2**64; ``second`` gives other hashes."""

    def __init__(self, data: np.ndarray, second: bool = False):
        up, self._down = _power(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_2 if second else _BYTE)[data] * up[: len(data)], out=self._sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Values that are not spread yet."""
        return (self._sums[ends] - self._sums[starts]) * self._down[starts]

    def run(self, lo: int, hi: int, n: int) -> np.ndarray:
        """``raw`` of the ``n`` bytes at each place from ``lo`` on that end by ``hi``."""
        return (self._sums[lo + n:hi + 1] - self._sums[lo:hi + 1 - n]) * self._down[lo:hi + 1 - n]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a document border."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


class Words:
    """The words of one slice: ``starts``, ``ends`` (bytes), ``hash``, and ``offsets`` of each document's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends = spans(WORD[data], offsets)
        self.hash = Rolling(self.data).hash(self.starts, self.ends) if len(data) else np.zeros(0, np.uint64)
        self.offsets = np.searchsorted(self.starts, offsets)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` consecutive words at each word, and whether all ``n`` lie in the same document."""
        total = len(self.hash)
        out = np.zeros(total, np.uint64)
        if total >= n:
            part = out[: total - n + 1]
            for j in range(n):
                part *= np.uint64(0xD6E8FEB86659FD93)
                part += self.hash[j:total - n + 1 + j]
            out[: total - n + 1] = mix(part)
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(total)
        return out, left >= n


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
