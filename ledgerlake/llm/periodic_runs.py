"""Maximal periodic runs of words by a Kruskal walk over descending LCP values.

A run is a stretch of consecutive words of smallest period q (words q apart are the
same) and length max(6, 4 q) at least that no neighbouring word extends.

1. Positions whose next five words occur nowhere else in their text can't lie in a run
   q words before its end, as a run's start agrees with the position q later for 3 q words, and
   for 5 if q is 1.  The others (and five behind each) are sorted as suffixes of their
   text, all texts of a batch together, by prefix doubling over pairs of ranks; only suffixes
   that are still tied are sorted again.
2. The ranks of the doubling steps give the longest common prefix (LCP) of neighbours in that order.
3. Neighbours are united in descending order of LCP by a union-find whose classes hold their
   positions in order, the smaller class going into the larger.  Positions i < j that become
   adjacent in a class at LCP l agree in exactly l words: with 3 (j - i) <= l they seed the run of
   period j - i from i to j + l, if the word before does not extend it.  That finds every run
   once: its start s and s + q are adjacent when they meet, as a suffix between them with so long a
   common prefix would make a smaller period.

Everything is inside one text, so documents are mapped without a shuffle, one batch of
``hashed_words.CHUNK`` bytes at a time (a longer text alone).  Words are compared by 64-bit hashes.

Defined cases: a null or empty text, or one without words, has no run and collapses to the
empty text.  Very long texts are taken whole, with memory in proportion to their words (and to the
logarithm of the longest repeat for those that repeat).  Repeated and null keys are rows of their own.
Ties for the strongest run go to the smallest start, then period.  An empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_words
from .common import key_and_text
from .word_buffers import joined

#: Periods that a run holds at least, words that it holds at least, and so many that its start shares with the place a period later.
PERIODS, LEAST, SHARED = 4, 6, 5
_RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"


def _repeated(word: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places (in order) that share their next ``SHARED`` words with another of their row, and so many behind each."""
    n = len(word)
    m = max(0, n - SHARED + 1)
    gram = row[:m].astype(np.uint64)
    for k in range(SHARED):
        gram = hashed_words.mixed(gram * np.uint64(0x9E3779B97F4A7C15) + word[k:k + m])
    inside = np.flatnonzero(np.arange(m) + SHARED <= end[:m])
    order = inside[np.argsort(gram[inside], kind="stable")]
    same = gram[order][1:] == gram[order][:-1]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, twice, 1)
    np.add.at(mark, np.minimum(twice + SHARED + 1, end[twice]), -1)
    return np.flatnonzero(np.cumsum(mark)[:-1] > 0)


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the rows of keys, most significant first, and where a new value begins."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def _suffixes(word: np.ndarray, row: np.ndarray, end: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places' suffixes in order (by index into ``place``), and each one's LCP with the one before (0: another row)."""
    s = len(place)
    index = np.full(len(word) + 1, -1, np.int32)
    index[place] = np.arange(s)
    keys = [row[place]]
    for k in range(SHARED):
        there = place + k < end[place]
        # The end of a row sorts before any word.
        keys += [there, np.where(there, word[np.minimum(place + k, len(word) - 1)], np.uint64(0))]
    order, new = _classes(keys)
    rank = np.empty(s, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(s), 0))
    levels, k = [rank.copy()], SHARED
    tied = _tied(rank, order)
    while len(tied):
        # A tied suffix has a place k words on, or ends there: then it sorts first.
        on = place[tied] + k
        beyond = on >= end[place[tied]]
        second = np.where(beyond, -1, rank[index[np.minimum(on, len(word))]])
        by = np.lexsort((second, rank[tied]))
        old, second = rank[tied][by], second[by]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        new = first | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(by))
        moved = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rank[tied[by]] = moved
        levels.append(rank.copy())
        tied, k = _tied(rank, tied[by]), 2 * k
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1], order[1:]
    both = row[place[left]] == row[place[right]]
    a, b = place[left].astype(np.int64), place[right].astype(np.int64)
    lcp = np.zeros(max(0, s - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = index[np.minimum(a, len(word))], index[np.minimum(b, len(word))]
        same = both & (i >= 0) & (j >= 0) & (a < end[place[left]]) & (b < end[place[right]])
        same &= levels[level][i] == levels[level][j]
        step = np.where(same, SHARED << level, 0)
        lcp, a, b = lcp + step, a + step, b + step
    for _ in range(SHARED - 1):
        same = both & (a < end[place[left]]) & (b < end[place[right]])
        same &= word[np.minimum(a, len(word) - 1)] == word[np.minimum(b, len(word) - 1)]
        both = same
        lcp, a, b = lcp + same, a + same, b + same
    return order, np.concatenate([[0], lcp])[:s]


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    r = rank[order]
    same = r[1:] == r[:-1]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(r) else order


def runs_of(word: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start in the row, length, period) of all runs; row r has the words first[r] to first[r + 1]."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    place = _repeated(word, row, end)
    if not len(place):
        return []
    order, lcp = _suffixes(word, row, end, place)
    pairs = np.flatnonzero(lcp >= SHARED)
    pairs = pairs[np.argsort(-lcp[pairs], kind="stable")]
    at, begin = place.tolist(), first[row[place]]
    before = np.where(place > begin, word[place - 1], np.uint64(0)).tolist()
    inner = (place > begin).tolist()
    parent = list(range(len(at)))
    held: list[list[int] | None] = [None] * len(at)  # None: the position alone
    out: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def adjacent(i: int, j: int, l: int) -> None:
        q = at[j] - at[i]
        if (PERIODS - 1) * q <= l and q + l >= LEAST and not (inner[i] and before[i] == before[j]):
            out.append((at[i], q + l, q))

    for x, y, l in zip(order[pairs - 1].tolist(), order[pairs].tolist(), lcp[pairs].tolist(), strict=True):
        x, y = root(x), root(y)
        a, b = held[x] or [x], held[y] or [y]
        if len(a) < len(b):
            x, y, a, b = y, x, b, a
        parent[y], held[x], held[y] = x, a, None
        for k in range(len(b) - 1, -1, -1):  # those behind are in already
            p = b[k]
            to = bisect_left(a, p)
            if to < len(a) and not (k + 1 < len(b) and b[k + 1] == a[to]):
                adjacent(p, a[to], l)
            if to and not (k and b[k - 1] > a[to - 1]):
                adjacent(a[to - 1], p, l)
            a.insert(to, p)
    return sorted((int(row[s]), s - int(first[row[s]]), n, q) for s, n, q in out)


def _kept(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Numbers of the words that no run holds behind its first period."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.flatnonzero(np.cumsum(mark)[:-1] == 0)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "length", "period")
    for batch in batches:
        for at, rows, data, offsets in hashed_words.chunks(batch.column("text")):
            words = joined(data, offsets, (data != 0x20) & ((data < 9) | (data > 13)))
            hashes = hashed_words.hashes(words.data, words.starts, words.starts + words.lengths)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for r, *run in runs_of(hashes, words.first):
                found.setdefault(r, []).append(tuple(run))
            texts, runs, best = [], [], []
            for r in range(rows):
                a, b = int(words.first[r]), int(words.first[r + 1])
                mine = found.get(r, [])
                texts.append(words.chosen(a + _kept(mine, b - a)) if mine else words.row(a, b))
                runs.append([dict(zip(names, x, strict=True)) for x in mine])
                top = _strongest(mine)
                best.append(dict(zip(names, top, strict=True)) if top else None)
            run_type = pa.struct([(n, pa.int64()) for n in names])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(at, rows), "n_words": pa.array(words.counts, pa.int64()),
                "runs": pa.array(runs, pa.list_(run_type)), "strongest": pa.array(best, run_type),
                "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its words' number, all runs (by start, then period), the one of the greatest exponent (length
    by period), and the text in which each run is collapsed to its first period, words joined by a blank."""
    return key_and_text(docs, key, text).mapInArrow(_map, SCHEMA)


def run_digests(docs: DataFrame, **options) -> DataFrame:
    """``periodic_runs`` with the runs and the collapsed text as checksums."""
    found = periodic_runs(docs, **options)
    top = F.col("strongest")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def planted_periods(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose key has a checksum h = crc32(decimal key) divisible by 10 get a periodic tail: of n words, those from
    a = g % n on repeat with period 1 + (n - a) div (3 + g % 8), where g = h div 10.  Null keys are left alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # A third of the words are looked up once for the whole tail: slices, and not a lookup a word.
    tail = F.expr("slice(w, a + 1, p)")
    whole = F.concat(F.expr("slice(w, 1, a)"), F.flatten(F.array_repeat(tail, F.expr("int((n - a) div p)"))), F.expr("slice(w, a + 1, int((n - a) % p))"))
    docs = key_and_text(docs, key, text)
    chosen = F.coalesce((h % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    made = (docs.withColumn("w", F.when(chosen, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
            .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
            .withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))")))
    return made.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
