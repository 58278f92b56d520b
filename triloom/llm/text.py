"""Words of texts, found and hashed over whole Arrow batches with numpy.

A word is a maximal run of bytes of a given class; A-Z count as a-z.  The 64-bit
hash of a word comes from prefix sums of byte values times powers of an odd
base, so a batch costs a fixed number of vector operations per byte however its
words are cut.  Whole texts are always read; long ones pass in windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_ONE = np.uint64(1)

_values = np.random.default_rng(20260105).integers(1, 2**63, 256, dtype=np.uint64)
_values[65:91] = _values[97:123]
BYTE_VALUES = _values

#: Everything but the ASCII white space characters.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters, digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW + 4096)
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = []
        for x in (_BASE, inverse):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of ``rows`` texts: their row, byte range in ``data``, and hash, in text order."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """For each row the index of its first word; one more at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about ``limit`` bytes; a longer row stands alone."""
    _, offsets = utf8(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high
        low = high


def scan(column: pa.Array, is_word: np.ndarray) -> Words:
    """The words of all texts of a column (a slice of bounded size, or one text)."""
    data, offsets = utf8(column)
    starts, ends, hashes = [], [], []
    low = 0
    while low < len(data):
        high = min(low + WINDOW, len(data))
        if high < len(data):
            high = _cut(data, offsets, is_word, low, high)
        s, e, h = _window(data[low:high], offsets, low, high, is_word)
        starts.append(s)
        ends.append(e)
        hashes.append(h)
        low = high
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start, end, h = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, offsets, row, start, end, h)


def _cut(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, low: int, high: int) -> int:
    """A place near high that splits no word."""
    back = np.flatnonzero(~is_word[data[low:high]])
    if len(back):
        return low + int(back[-1]) + 1
    inner = offsets[(offsets > low) & (offsets <= high)]
    if len(inner):
        return int(inner[-1])
    while high < len(data):
        ahead = np.flatnonzero(~is_word[data[high : high + WINDOW]])
        stop = high + (int(ahead[0]) if len(ahead) else WINDOW)
        edge = offsets[(offsets > low) & (offsets <= stop)]
        if len(edge):
            return int(edge[0])
        if len(ahead):
            return stop
        high = stop
    return len(data)


def _window(data: np.ndarray, offsets: np.ndarray, low: int, high: int, is_word: np.ndarray):
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= low) & (offsets <= high)] - low] = True
    begins = inside[1:] & (~inside[:-1] | edge)
    stops = inside[:-1] & (~inside[1:] | edge)
    start, end = np.flatnonzero(begins[:n]), np.flatnonzero(stops)
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power, out=total[1:])
    h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)
    return start + low, end + low, mix(h)


_GRAM = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | _ONE


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes, whatever rows they cross."""
    count = len(h) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, size, np.uint64) * _GRAM[-1]
    for k in range(size):
        total += mix(h[k : k + count] + _GRAM[k % 63]) * _GRAM[(k * 7 + 3) % 63]
    return mix(total)
