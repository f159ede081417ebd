"""Benchmark decontamination by Wu-Manber multi-pattern search.

A benchmark item's windows are its runs of ``n`` consecutive words (an item of fewer
words is one window); a document's word inside any occurrence of a window is hit.
Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.

Windows are patterns of bytes " w1 ... wn ", parted by length into four groups with
a least length m each.  For blocks of B bytes, a shift table tells how far the last
block of a position's first m bytes is at least from the end of any pattern's first
m bytes: so far the search moves on without a look at what it skips.  Where the
shift is zero, the bucket of that block (the patterns whose first m bytes end with it, by
their first block) gives the patterns, and a comparison of all bytes confirms an
occurrence.  The many segments of a batch of texts are searched side by side in numpy.

Documents are scanned in one narrow map, without a shuffle.  Items are cut into pieces of
``PIECE_WORDS`` words (which overlap, so no window is lost), and pieces are dealt into
blocks of about ``BLOCK_BYTES``; the documents pass the blocks one after the other, each
broadcast with its tables (some 30 times its bytes, so 60 MB).  Nothing else of
the benchmark is held at once, on the driver or in a task.

Defined cases: null and empty texts, or texts without a word, have no words: a document
has no hit then, an item no window.  An item's repeats count once; windows of
an item without an id hit words, but it isn't listed.  A repeated or null document key is a
row of its own.  Very long texts are searched whole, by segments.  Empty tables give
no rows, or rows without hits; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_words
from .common import key_and_text, rewritten
from .word_buffers import Words, joined

WINDOW = 10
#: Words of a piece of an item, and bytes of the pieces that are searched for together.
PIECE_WORDS, BLOCK_BYTES = 1000, 2_000_000
#: Pattern lengths (bytes) from which a group of its own begins: a short pattern would shorten all shifts.
GROUPS = (1, 8, 16, 32)
#: Bytes that are searched together, and positions of one segment.
SEARCHED, SEGMENT = 1 << 20, 256
#: Pairs of a place and a pattern that are compared together.
COMPARED = 1 << 14
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: By byte: lower-cased, and whether it is part of a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _LOWER[data]
    return joined(low, offsets, _INSIDE[low])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()


class Group:
    """Shift table and buckets of patterns of m bytes at least."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray):
        self.m = m = int(lengths.min())
        self.b = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        eight = _eights(data)
        bits = min(22, max(12, (4 * len(starts) * (m - b + 1)).bit_length()))
        self.right = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - b + 1, np.int32)
        for j in range(m - b + 1):  # later blocks have the smaller shifts
            self.shift[self.hashed(eight[starts + j] & self.mask)] = m - b - j
        last, head = eight[starts + m - b] & self.mask, eight[starts] & self.mask
        order = np.lexsort((head, last))
        self.last, self.head = last[order], head[order]
        self.data, self.starts, self.lengths, self.numbers = data, starts[order], lengths[order], numbers[order]

    def hashed(self, block: np.ndarray) -> np.ndarray:
        return ((block * _FACTOR) >> self.right).astype(np.int64)

    def places(self, eight: np.ndarray, n: int) -> np.ndarray:
        """Starts of the pattern places with shift zero, among the n bytes whose blocks are given."""
        back = self.m - self.b
        low = np.arange(back, n - self.b + 1, SEGMENT)
        high = np.minimum(low + SEGMENT, n - self.b + 1)
        found = []
        while len(low):
            shift = self.shift[self.hashed(eight[low] & self.mask)]
            found.append(low[shift == 0])
            low = low + np.maximum(shift, 1)
            on = low < high
            low, high = low[on], high[on]
        return np.concatenate(found) - back if found else np.zeros(0, np.int64)

    def find(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, patterns) of all occurrences in ``data``."""
        for a in range(0, max(1, len(data)), SEARCHED):
            part = data[a:a + SEARCHED + self.m - 1]
            eight = _eights(part)
            at = self.places(eight, len(part))
            if not len(at):
                continue
            block, head = eight[at + self.m - self.b] & self.mask, eight[at] & self.mask
            left, right = np.searchsorted(self.last, block), np.searchsorted(self.last, block, "right")
            some = right > left
            yield from self._confirmed(data, a + at[some], head[some], left[some], right[some])

    def _confirmed(self, data, at, head, left, right):
        count = right - left
        upto = np.cumsum(count)
        k = 0
        while k < len(at):  # pairs of a place and a pattern of its bucket, so many at a time
            to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + COMPARED, "right")))
            for low in range(0, int(count[k:to].max()), COMPARED):  # one place's bucket may be larger
                size = np.clip(count[k:to] - low, 0, COMPARED)
                place = np.repeat(np.arange(k, to), size)
                pattern = np.repeat(left[k:to] + low - (np.cumsum(size) - size), size) + np.arange(len(place))
                fit = (self.head[pattern] == head[place]) & (at[place] + self.lengths[pattern] <= len(data))
                place, pattern = at[place[fit]], pattern[fit]
                if len(place):
                    size = self.lengths[pattern]
                    before = np.cumsum(size) - size
                    step = np.arange(int(size.sum()))
                    same = data[np.repeat(place - before, size) + step] == self.data[np.repeat(self.starts[pattern] - before, size) + step]
                    whole = np.logical_and.reduceat(same, before)
                    yield place[whole], self.numbers[pattern[whole]]
            k = to


class Patterns:
    """Distinct windows of pieces (item id or None, words joined by blanks), with their items."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], n: int):
        windows: dict[bytes, set[int]] = {}
        self.ids = sorted({i for i, _ in pieces if i is not None})
        number = {i: k for k, i in enumerate(self.ids)} | {None: -1}
        for item, text in pieces:
            words = text.split(b" ")
            for k in range(max(1, len(words) - n + 1)):
                windows.setdefault(b" " + b" ".join(words[k:k + n]) + b" ", set()).add(number[item])
        data = np.frombuffer(b"".join(windows), np.uint8)
        lengths = np.array([len(w) for w in windows], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.words = np.array([w.count(b" ") - 1 for w in windows], np.int64)
        self.items = np.array([k for s in windows.values() for k in sorted(s)], np.int64)
        self.first = np.cumsum([0] + [len(s) for s in windows.values()])
        kind = np.searchsorted(GROUPS, lengths, "right")
        self.groups = [Group(data, starts[g], lengths[g], g) for g in (np.flatnonzero(kind == k) for k in np.unique(kind))]

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        found = [f for g in self.groups for f in g.find(words.data)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, pattern = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.searchsorted(words.starts, place + 1), pattern


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


#: Spans are runs of hit words: starts, and ends behind them.
_FOUND = "n_words long, n_hit long, starts array<long>, ends array<long>, item_ids array<string>"


def _scan(held, last: bool):
    """A pass over the documents with one block of patterns; what earlier passes found comes with them."""

    def scanned(batch: pa.RecordBatch, patterns: Patterns) -> Iterator[pa.RecordBatch]:
        text = batch.column("text")
        old = batch.column("n_hit") if "n_hit" in batch.schema.names else None
        for at, rows, data, offsets in hashed_words.chunks(text):
            words = words_of(data, offsets)
            begin, pattern = patterns.occurrences(words)
            mark = np.zeros(int(words.first[-1]) + 1, np.int64)
            np.add.at(mark, begin, 1)
            np.add.at(mark, begin + patterns.words[pattern], -1)
            hit = np.cumsum(mark)[:-1] > 0
            row = np.searchsorted(words.first, begin, "right") - 1
            pairs = np.unique(np.stack([row, pattern], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
            found: dict[int, set[str]] = {}
            for r, p in pairs.tolist():
                found.setdefault(r, set()).update(patterns.ids[k] for k in patterns.items[patterns.first[p]:patterns.first[p + 1]].tolist() if k >= 0)
            out = []
            for r in range(rows):
                a, b = int(words.first[r]), int(words.first[r + 1])
                mine, ids = hit[a:b], found.get(r, set())
                if old is not None and old[at + r].as_py():
                    mine = mine.copy()
                    for s, e in zip(batch.column("starts")[at + r].as_py(), batch.column("ends")[at + r].as_py(), strict=True):
                        mine[s:e] = True
                    ids = ids | set(batch.column("item_ids")[at + r].as_py())
                out.append((b - a, int(np.count_nonzero(mine)), *(_spans(mine) if r in found or old is not None else ([], [])), sorted(ids, key=str.encode)))
            cols = {n: batch.column(n).slice(at, rows) for n in ("doc_id",) + (() if last else ("text",))}
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            cols |= {n: pa.array(list(v), t) for n, v, t in zip(("n_words", "n_hit", "starts", "ends", "item_ids"), zip(*out, strict=True), types, strict=True)}
            yield pa.RecordBatch.from_pydict(cols)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from scanned(batch, held.value)

    return fn


def _pieces(n: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in hashed_words.chunks(batch.column("text")):
                words = words_of(data, offsets)
                ids, out = batch.column("item_id"), []
                for r in range(rows):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    for k in range(a, max(a, b - n + 1) if b - a >= n else b, PIECE_WORDS):
                        out.append((ids[at + r].as_py(), words.row(k, min(b, k + PIECE_WORDS + n - 1))))
                        if b - a < n:
                            break
                if out:
                    item, text = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.string()), "words": pa.array(text, pa.binary())})

    return fn


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, *, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document doc_id, n_words, n_hit, the spans of hit words (starts, ends: word numbers, ends
    exclusive) and item_ids (sorted strings: items with a window there)."""
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_key].cast("string").alias("item_id"), benchmark[item_text].cast("string").alias("text"))
    pieces = rewritten(items.mapInArrow(_pieces(n), "item_id string, words binary"), "benchmark-pieces")
    size = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = key_and_text(docs, key, text)
    for k in range(blocks):
        # About block_bytes, whatever the benchmark: rows are dealt by a hash.
        block = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).distinct().collect()
        held = spark.sparkContext.broadcast(Patterns([(r[0], bytes(r[1])) for r in block], n))
        last = k == blocks - 1
        out = out.mapInArrow(_scan(held, last), "doc_id long, " + ("" if last else "text string, ") + _FOUND)
    return out


def contamination_digests(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, **options) -> DataFrame:
    """``contamination`` with the items as a count and a checksum of their sorted, comma-joined ids."""
    found = contamination(docs, benchmark, n, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
