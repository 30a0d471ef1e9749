"""Word boundaries and word hashes of whole Arrow batches, by numpy, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pixelyard.llm.common import PIECE_BYTES

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[32, 9, 10, 11, 12, 13]] = False

BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1), modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_powers)), BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of consecutive texts. ``first`` and ``last`` are the texts' row numbers in the batch."""

    first: int
    last: int
    data: np.ndarray
    """bytes, A-Z lower-cased"""
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    """of each word, counted from ``first``"""
    begin: np.ndarray
    """index of each text's first word; one more entry at the end"""
    at: np.ndarray
    """byte at which each text begins; one more entry at the end"""

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.begin)

    def hashes(self, width: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``width`` bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        if width is not None:
            lengths = np.minimum(lengths, width)
        at = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        byte = self.data[np.repeat(self.starts, lengths) + inside].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(byte * powers(int(lengths.max()))[inside], at))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the rows' offsets in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; every row is in exactly one."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(column: pa.Array, kind: np.ndarray = ALNUM) -> Iterator[Words]:
    """The words of every row of a string column, piece by piece."""
    data, offsets = flat(column)
    for first, last in pieces(offsets):
        low = LOWER[data[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        is_word = kind[low]
        opens, closes = is_word.copy(), is_word.copy()
        opens[1:] &= ~is_word[:-1]
        closes[:-1] &= ~is_word[1:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(low))]
        opens[inner] |= is_word[inner]
        closes[inner - 1] |= is_word[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        doc = np.searchsorted(at, starts, side="right") - 1
        begin = np.searchsorted(doc, np.arange(last - first + 1), side="left")
        yield Words(first, last, low, starts, ends, doc, begin, at)
