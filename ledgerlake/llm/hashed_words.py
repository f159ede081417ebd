"""Words of an Arrow column of texts as byte ranges with 64-bit hashes.

All texts of a batch are cut and hashed in numpy over the column's own buffers,
without a Python string for each word.  A word's hash is a polynomial over random
values of its bytes, from differences of one running sum; ``Table`` maps
hashes to small integers, and only words that it lacks become strings.  Two
different words share a hash with a chance of about 2^-57, so a table of a
million words confuses any two of them with a chance below 1e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes handled together (a longer text is handled alone).
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            have = _powers[k]
            _powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _powers[0], _powers[1]


def chunks(column: pa.Array, size: int = CHUNK):
    """(first row, rows, bytes, row offsets) of runs of rows of about ``size`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if n else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to - at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def cut(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs between blanks (empty ones too), and their number per row."""
    starts = np.sort(np.concatenate([offsets[:-1], blanks + 1]), kind="stable")
    ends = np.sort(np.concatenate([blanks, offsets[1:]]), kind="stable")
    inside = np.searchsorted(blanks, offsets)
    return starts, ends, np.diff(inside) + 1


@np.errstate(over="ignore")
def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, back = _upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Table:
    """Open-addressed map from hashes to the numbers 0, 1, 2, ... in order of arrival."""

    def __init__(self, bits: int = 16):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for those that are not there."""
        at = (h & self.mask).astype(np.int64)
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        out[left] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            value = self.values[at]
            hit = (self.keys[at] == h[left]) & (value >= 0)
            out[left[hit]] = value[hit]
            go = ~hit & (value >= 0)
            left, at = left[go], at[go]
        return out

    def add(self, new: np.ndarray) -> np.ndarray:
        """Numbers of distinct hashes that are not there yet."""
        while (self.size + len(new)) * 3 > len(self.keys):
            old = np.flatnonzero(self.values >= 0)
            keys, values = self.keys[old], self.values[old]
            bits = len(self.keys).bit_length()
            self.mask, self.keys, self.values = np.uint64((1 << bits) - 1), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
            self._put(keys, values)
        numbers = np.arange(self.size, self.size + len(new))
        self._put(new, numbers)
        self.size += len(new)
        return numbers

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.values[at] < 0
            self.values[at[free]] = values[left[free]]  # of several, one remains
            self.keys[at[free]] = keys[left[free]]
            done = self.values[at] == values[left]
            self.keys[at[done]] = keys[left[done]]
            left, at = left[~done], (at[~done] + 1) & int(self.mask)
