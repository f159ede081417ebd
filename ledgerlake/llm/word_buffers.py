"""The words of many texts, joined by single blanks in one buffer of bytes.

A row's words stand in the buffer as " w1 w2 w3 " and a zero byte behind, so that a
word with its blanks is found as bytes, and nothing that is found crosses a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Words:
    """``data`` with the starts and lengths of words there, and the number of the first word of each row (and behind the last)."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self, a: int, b: int) -> bytes:
        """Words a to b (one row's) with single blanks between."""
        return self.data[self.starts[a]:self.starts[b - 1] + self.lengths[b - 1]].tobytes() if b > a else b""

    def chosen(self, words: np.ndarray) -> bytes:
        """The words of these numbers with single blanks between."""
        if not len(words):
            return b""
        size = self.lengths[words] + 1
        before = np.cumsum(size) - size
        return self.data[np.repeat(self.starts[words] - before, size) + np.arange(int(size.sum()))].tobytes()[:-1]


def joined(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """``inside`` marks the bytes of words; rows are data[offsets[r]:offsets[r + 1]]."""
    n = len(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word doesn't go on in the next row
    begin[rows] = inside[rows]
    at = np.flatnonzero(begin)
    total = int(np.count_nonzero(inside))
    before = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    lengths = np.diff(np.append(before[at], total))
    first = np.searchsorted(at, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    starts = before[at] + np.arange(len(at)) + 1 + 2 * row
    out = np.full(total + len(at) + 2 * (len(offsets) - 1), 0x20, np.uint8)
    out[np.repeat(starts - before[at], lengths) + np.arange(total)] = data[inside]
    out[(before[offsets[1:]] + first[1:] + 2 * np.arange(1, len(offsets)) - 1)] = 0
    return Words(out, starts, lengths, first)
