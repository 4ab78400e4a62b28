"""Vectorised scans over Arrow text columns: words, hashes, shingles. Used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GRAM = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB),
         np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
#: Bytes of text handled at once, at some hundred bytes of arrays for each; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of other scripts.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False

def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    tables = []
    for step in (_BASE, _INVERSE):
        table = np.full(max(n, 1), step, dtype=np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows after each other, and the row borders; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    borders = borders[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[borders[0]: borders[-1]], borders - borders[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges (from, to) of about ``limit`` bytes each; every row is in exactly one."""
    _, borders = text_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(borders, borders[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


class Words:
    """Words of a slice of rows: row, first byte, byte after the last, and a 64-bit hash each."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, separators: np.ndarray = WHITE,
                 fold: np.ndarray | None = LOWER):
        n = len(data)
        self.data = data if fold is None else fold[data]
        inside = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[borders] = True
        opens = inside.copy()
        closes = inside.copy()
        if n:
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(borders, self.start, side="right") - 1
        # each byte by its place in its word, so that equal words have equal sums
        at = np.arange(n)
        place = at - np.maximum.accumulate(np.where(opens, at, 0)) if n else at
        longest = int((self.end - self.start).max(initial=0))
        np.minimum(place, max(longest - 1, 0), out=place)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(longest)[0][place], out=self._sums[1:])
        self.hash = self.prefix_hash(self.end)

    def prefix_hash(self, end: np.ndarray) -> np.ndarray:
        """Hash of each word's bytes up to ``end``."""
        return mix(self._sums[end] - self._sums[self.start])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``k`` words of one row."""
        if len(self.row) < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        first = np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1:])
        total = np.zeros(len(first), dtype=np.uint64)
        for j in range(k):
            total += self.hash[first + j] * (_GRAM[j % len(_GRAM)] + np.uint64(2 * j))
        return first, mix(total)

    def sequence_hash(self, lo: int, hi: int) -> int:
        """Hash of the words lo..hi-1 as one sequence."""
        total, lo, hi = 0, int(lo), int(hi)
        for h in self.hash[lo:hi].tolist():
            total = (total * 0xD6E8FEB86659FD93 + h + (hi - lo)) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([total ^ (hi - lo)], dtype=np.uint64))[0])
