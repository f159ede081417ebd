"""N-gram Jaccard self-join by prefix trees, with connected components.

Two documents link if ``100 * intersection >= percent * union`` of their word
n-gram sets.  The join is exact (up to 64-bit hashes of n-grams):

1. Sets.  A map hashes each text's n-grams.  Equal sets form a class, known by a
   fingerprint of the set; from here on a class stands for all its documents.
   Each task also counts its n-grams and reports its most frequent ones; the
   ``HEAVY`` largest sums give the global order: n-grams not among them first (by
   hash), then those in ascending frequency.  Any order is right, this one
   keeps passages that many documents share out of the prefixes.
2. Prefixes.  Linked sets share one of their first n - ceil(percent n / 100) + 1
   n-grams in global order, and several of a prefix that is longer by a third.  Rows
   (n-gram, class) of such prefixes are dealt by n-gram; n-grams of a single class
   drop out, and then classes with fewer shared ones than a link needs.  Frequent
   n-grams are known already and are spread, not gathered.
3. Candidates.  N-grams with the same members are one bucket.  A bucket stores its
   classes' shared prefix n-grams in a trie; each class walks the trie, sharing the overlap
   so far with all classes below a node, and leaves a subtree if the lengths left
   cannot reach the needed overlap.  A class that may link with another stays, and
   only such classes bring their whole sets.
4. First meeting.  Each class goes to one bucket, that with most members.  The whole
   sets are joined by a trie in the same way; a subtree is also left if it is already
   connected with the set.  A large bucket is cut into blocks, whose components send
   a representative each to another meeting.
5. Remaining pairs.  Only buckets that still join different components need a look
   (large ones block against block); a pair is compared in the bucket of its first
   common n-gram, and what is found is merged by connected components.

Nothing is capped: links are skipped only within what is already connected.

Defined cases: documents without words or with a null text have an empty set
and link with nothing; equal sets link; null keys never become a component's
id unless all of its keys are null; rows that repeat a key are rows of their own;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashed_words
from .common import MOST_BROADCAST, broadcast_if_small, key_and_text, lean, one_of_repeats, rewritten
from .components import components

#: Frequent n-grams that the order knows (broadcast with the tasks: 4 MB).
HEAVY = 1 << 18
#: Frequent n-grams a task reports, and counts that it holds meanwhile.
REPORTED, COUNTED = 1 << 16, 1 << 19
#: A prefix is longer than the least by this part of it: as many of its n-grams must be shared.
MORE = 3
#: Sets and n-grams of a block at most (more make more blocks); 2 M n-grams are 16 MB.
BLOCK_SETS, BLOCK_GRAMS = 2000, 2_000_000
MEMO_CLASSES = 500_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_TOP = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams (of all its words, if fewer); ASCII
    letters lower-cased, words parted by blank and U+0009 to U+000D."""
    out: list[np.ndarray] = []
    for _, rows, data, offsets in hashed_words.chunks(column):
        data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
        starts, ends, _ = hashed_words.cut(data, offsets, np.flatnonzero((data == 0x20) | (data >= 9) & (data <= 13)))
        real = ends > starts
        starts, ends = starts[real], ends[real]
        word = hashed_words.hashes(data, starts, ends)
        first = np.searchsorted(starts, offsets)  # of each row; and behind the last
        count = np.diff(first)
        h = np.full(max(0, len(word) - n + 1), n, np.uint64)
        for k in range(n):
            h = _mixed(h * _MIX[2] + word[k:k + len(h)])
        for a, m in zip(first[:-1].tolist(), count.tolist(), strict=True):
            if m >= n:
                out.append(np.unique(h[a:a + m - n + 1]))
            else:
                g = np.full(min(m, 1), m, np.uint64)
                for k in range(m):
                    g = _mixed(g * _MIX[2] + word[a + k])
                out.append(g)
    return out


def fingerprint(grams: np.ndarray) -> int:
    """A class's number: depends on the set alone."""
    total = int(_mixed(grams ^ _MIX[2]).sum(dtype=np.uint64)) ^ int(grams.sum(dtype=np.uint64)) * 3 ^ len(grams)
    return xxhash.xxh64_intdigest(total.to_bytes(9, "little")) - (1 << 63)


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Of two linked sets, of which this is one of size n, the first so many n-grams share one."""
    return n - -(-percent * n // 100) + 1


def prefix_taken(n: int, percent: int) -> int:
    """The prefix length used: longer, so that linked sets share several of its n-grams
    (``shared_least``).  Taking k - 1 n-grams more than ``prefix_length``, sets of one size share k; of
    sizes n and less, k - 1 at least, as percent n / 100 - k falls nowhere by over 1 while n grows."""
    if percent < 50:
        return prefix_length(n, percent)
    p = prefix_length(n, percent)
    return p + min(p // MORE, -(-percent * n // 100) - 1)


def shared_least(n: int, percent: int) -> int:
    return max(1, prefix_taken(n, percent) - prefix_length(n, percent))


def rest_most(n: np.ndarray, percent: int) -> np.ndarray:
    """n-grams behind the prefix that is taken, of sets of sizes n."""
    need = -(-percent * n // 100)
    p = n - need + 1
    return n - p - (np.minimum(p // MORE, need - 1) if percent >= 50 else 0)


def ordered(grams: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set as ascending keys of the global order; ``heavy`` is sorted."""
    keys = grams >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)
        keys = np.where(heavy[at] == grams, _TOP + rank[at], keys)
    return np.sort(keys)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _summaries(n: int):
    """Rows (doc_id, text_key, size, class) and, with class null, (n-gram, count) in text_key and size."""

    def run(batches):
        counts: dict[int, int] = {}
        for b in batches:
            sets = shingle_sets(b.column(2), n)
            classes = [fingerprint(s) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64())], ["doc_id", "text_key", "size", "class"])
            once = {c: s for c, s in zip(classes, sets, strict=True) if len(s)}
            if once:
                grams, times = np.unique(np.concatenate(list(once.values())), return_counts=True)
                often = np.flatnonzero(times > 1)
                if len(often) > COUNTED // 2:
                    often = often[np.argsort(times[often])[-(COUNTED // 2):]]
                for g, t in zip(grams[often].tolist(), times[often].tolist(), strict=True):
                    counts[g] = counts.get(g, 0) + t
                if len(counts) > COUNTED:
                    counts = dict(sorted(counts.items(), key=lambda x: -x[1])[:COUNTED // 2])
        top = sorted(counts.items(), key=lambda x: -x[1])[:REPORTED]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int64()), _signed(np.array([g for g, _ in top], np.uint64)), pa.array([t for _, t in top], pa.int64()), pa.nulls(len(top), pa.int64())],
                                         ["doc_id", "text_key", "size", "class"])

    return run


def _prefixes(n: int, percent: int, heavy: np.ndarray, rank: np.ndarray):
    """Rows (gram, class, size, spread): the prefix of each class, once per task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], []]
            if len(seen) > MEMO_CLASSES:
                seen.clear()
            for s in shingle_sets(b.column(0), n):
                if len(s) and (c := fingerprint(s)) not in seen:
                    seen.add(c)
                    p = ordered(s, heavy, rank)[:prefix_taken(len(s), percent)]
                    for col, v in zip(cols, (p, np.full(len(p), c, np.int64), np.full(len(p), len(s), np.int32)), strict=True):
                        col.append(v)
            if cols[0]:
                gram = np.concatenate(cols[0])
                own = np.concatenate(cols[1])
                yield pa.RecordBatch.from_arrays([_signed(gram), pa.array(own), pa.array(np.concatenate(cols[2])), pa.array(np.where(gram >= _TOP, own & 1023, -1).astype(np.int16))], ["gram", "class", "size", "spread"])

    return run


def _sets(n: int, heavy: np.ndarray, rank: np.ndarray):
    def run(batches):
        for b in batches:
            grams = [ordered(s, heavy, rank) for s in shingle_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in grams], pa.binary())], ["class", "grams"])

    return run


#: Added to an overlap by an n-gram that makes the pair pass.
FAR = 1 << 40


def _over(f: np.ufunc, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``f`` over each run of values."""
    return f.reduceat(np.append(values, values[-1:]), np.stack([low, high], 1).ravel())[::2]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of runs that begin at ``start``, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


class Trie:
    """Ordered sets that share their beginnings.

    Nodes are numbered level by level, so that a node's kids follow one another; the
    members below a node are a run of the sorted sets.  ``sizes`` count also those n-grams
    that no other member has, which the trie leaves out."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, width: int):
        self.sets, self.sizes, self.width = sets, sizes, width
        rows = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.rows = np.array(rows)
        # Depth-first: [parent, depth above, depth, first member, member after the last].
        nodes: list[list[int]] = [[-1, 0, 0, 0, len(rows)]]
        path = [0]
        for at, k in enumerate(rows):
            s, lcp = sets[k], 0
            if at:
                last = sets[rows[at - 1]]
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                lcp = int(differ[0]) if len(differ) else m
            while nodes[path[-1]][2] > lcp:
                low = path.pop()
                nodes[low][4] = at
                if nodes[path[-1]][2] < lcp:  # the edge parts at lcp
                    nodes.append([nodes[low][0], nodes[low][1], lcp, nodes[low][3], -1])
                    nodes[low][0], nodes[low][1] = len(nodes) - 1, lcp
                    path.append(len(nodes) - 1)
            if len(s) > nodes[path[-1]][2]:
                nodes.append([path[-1], nodes[path[-1]][2], len(s), at, -1])
                path.append(len(nodes) - 1)
        for low in path:
            nodes[low][4] = len(rows)
        kids: list[list[int]] = [[] for _ in nodes]
        for k, node in enumerate(nodes[1:], 1):
            kids[node[0]].append(k)
        order = [0]
        for k in order:
            order += kids[k]
        table = np.array(nodes)[order]
        above, self.depth, self.low, self.high = (table[:, c] for c in range(1, 5))
        self.kids = np.array([len(kids[k]) for k in order])
        self.kid = np.cumsum(self.kids) - self.kids + 1
        self.edge = self.depth - above
        self.at = np.cumsum(self.edge) - self.edge
        self.flat = np.concatenate([np.empty(0, np.int64), *(sets[rows[lo]][a:d] for lo, a, d in zip(self.low.tolist(), above.tolist(), self.depth.tolist(), strict=True))])
        self.last = np.append(self.flat, 0)[self.at + np.maximum(self.edge, 1) - 1]
        own, deep = sizes[self.rows], np.array([len(sets[k]) for k in rows])
        self.least, self.largest, self.first, self.deepest = (
            _over(f, v, self.low, self.high) for f, v in ((np.minimum, own), (np.maximum, own), (np.minimum, self.rows), (np.maximum, deep)))
        # Members that end at a node come first in its run.
        full = np.array([len(sets[k]) for k in rows])
        self.ends = np.array([int(np.searchsorted(full[lo:hi] > d, True)) for lo, hi, d in zip(self.low.tolist(), self.high.tolist(), self.depth.tolist(), strict=True)])

    def _reach(self, x: int, mark: np.ndarray, percent: int, skip: np.ndarray, need):
        """Walk set ``x`` (its n-grams marked) down the trie, level by level; gives earlier members
        that end on the way, with their overlaps.  Subtrees are left that ``skip`` says, that
        have no fitting size, or where what is left cannot reach ``need(nodes)``."""
        own, size = self.sets[x], int(self.sizes[x])
        least, most = -(-size * percent // 100), size * 100 // percent
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            many = self.kids[node]
            overlap = np.repeat(overlap, many)
            node = _ranges(self.kid[node], many)
            keep = (self.first[node] < x) & (self.largest[node] >= least) & (self.least[node] <= most) & ~skip[node]
            node, overlap = node[keep], overlap[keep]
            if not len(node):
                return
            edge = self.edge[node]
            overlap = overlap + np.add.reduceat(mark[self.flat[_ranges(self.at[node], edge)]], np.cumsum(edge) - edge)
            rest = len(own) - np.searchsorted(own, self.last[node], "right")
            keep = (overlap < FAR) & (overlap + np.minimum(rest, self.deepest[node] - self.depth[node]) >= need(node))
            node, overlap = node[keep], overlap[keep]
            ends = self.ends[node]
            if ends.any():
                k, n = self.rows[_ranges(self.low[node], ends)], np.repeat(overlap, ends)
                good = (k < x) & (self.sizes[k] >= least) & (self.sizes[k] <= most)
                yield k[good], n[good]

    def links(self, percent: int, label: np.ndarray, before: int = 0) -> list[tuple[int, int]]:
        """Links that connect what ``label`` has apart.  Pairs with a common n-gram below
        ``before`` meet elsewhere and are passed over."""
        found: list[tuple[int, int]] = []
        mark = np.zeros(self.width, np.int64)
        label = label.copy()
        only = self._only(label)
        for x in range(1, len(self.sets)):
            own, size, joined = self.sets[x], int(self.sizes[x]), False
            if not len(own) or only[0] >= 0:
                continue
            mark[own] = np.where(own < before, FAR, 1)
            least = -(-size * percent // 100)
            need = lambda node: -(-percent * (size + np.maximum(self.least[node], least)) // (100 + percent))  # noqa: B023, E731
            for k, overlap in self._reach(x, mark, percent, only == label[x], need):
                good = (overlap * (100 + percent) >= percent * (size + self.sizes[k])) & (label[k] != label[x])
                for y in k[good].tolist():
                    if label[y] != label[x]:
                        found.append((y, x))
                        label[label == label[x]] = label[y]
                        joined = True
            mark[own] = 0
            if joined:
                only = self._only(label)
        return found

    def partners(self, percent: int, label: np.ndarray, before: int = 0) -> np.ndarray:
        """Which sets, known here by their prefixes, may link with one of another label.

        Of two sets, let x be the one whose prefix ends first in the order: all they have in
        common up to there is in both prefixes, and x has ``rest_most`` n-grams more.  So the
        overlap of prefixes is at least what a link needs less the larger rest of both."""
        out = np.zeros(len(self.sets), bool)
        mark = np.zeros(self.width, np.int64)
        rest = rest_most(self.sizes, percent)
        below = _over(np.maximum, rest[self.rows], self.low, self.high)
        only = self._only(label)
        done = np.zeros(len(self.low), bool)
        for x in range(1, len(self.sets)):
            own, size = self.sets[x], int(self.sizes[x])
            if not len(own):
                continue
            mark[own] = np.where(own < before, FAR, 1)
            news, least = False, -(-size * percent // 100)
            need = lambda node: np.maximum(1, -(-percent * (size + np.maximum(self.least[node], least)) // (100 + percent)) - np.maximum(rest[x], below[node]))  # noqa: B023, E731
            for k, overlap in self._reach(x, mark, percent, (only == label[x]) | (done & out[x]), need):
                enough = -(-percent * (size + self.sizes[k]) // (100 + percent)) - np.maximum(rest[x], rest[k])
                good = k[(overlap >= np.maximum(1, enough)) & (label[k] != label[x])]
                if len(good) and not (out[x] and out[good].all()):
                    out[good] = out[x] = news = True
            mark[own] = 0
            if news:
                done = _over(np.minimum, out[self.rows].astype(np.int8), self.low, self.high) > 0
        return out

    def _only(self, label: np.ndarray) -> np.ndarray:
        """The label of all members below a node, -1 if there are several."""
        run = label[self.rows]
        change = np.append(0, np.cumsum(run[1:] != run[:-1]))
        return np.where(change[self.low] == change[self.high - 1], run[self.low], -1)


def _local(sets: list[np.ndarray], sizes: np.ndarray, before: int) -> tuple[Trie, int]:
    """The trie of what at least two of the sets share, numbered densely in order, and ``before`` so numbered."""
    keys, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    dense = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
    local = [part[part >= 0] for part in np.split(dense, np.cumsum([len(s) for s in sets])[:-1])]
    return Trie(local, sizes, int(shared.sum()) + 1), int((shared & (keys < np.uint64(before))).sum())


def _labels(apart: list[int]) -> np.ndarray:
    heads: dict[int, int] = {}
    return np.array([heads.setdefault(c, k) for k, c in enumerate(apart)])


def linked(sets: list[np.ndarray], percent: int, apart: list[int] | None = None, before: int = 0) -> list[tuple[int, int]]:
    """Links over ordered key arrays, by size, that suffice to connect all that links connect;
    ``apart`` labels what is connected already, pairs with a common key below ``before`` may be left out."""
    label = _labels(apart) if apart else np.arange(len(sets))
    if len(sets) == 2:  # a trie of two sets has one question
        both = np.intersect1d(*sets, assume_unique=True)
        good = len(both) >= needed(len(sets[0]), len(sets[1]), percent) and label[0] != label[1]
        return [(0, 1)] if good and not (both < np.uint64(before)).any() else []
    trie, first = _local(sets, np.array([len(s) for s in sets]), before)
    return trie.links(percent, label, first)


def paired(prefixes: list[np.ndarray], sizes: np.ndarray, percent: int, before: int) -> np.ndarray:
    """Which sets, known by their prefixes, share enough with another to be compared whole."""
    trie, first = _local(prefixes, sizes, before)
    return trie.partners(percent, np.arange(len(sizes)), first)


def _rooted(rows: list[tuple], bucket: int, percent: int) -> list[tuple[int, int]]:
    """(class, its root) of all rows of a meeting."""
    found = linked([r[1] for r in rows], percent) if len(rows) > 1 else []
    of = list(range(len(rows)))

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    for a, b in found:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return [(r[0], rows[root(k)][0]) for k, r in enumerate(rows)]


def _bridges(rows: list[tuple], bucket: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that links of this bucket connect."""
    apart = [r[2] for r in rows]
    found = linked([r[1] for r in rows], percent, apart, bucket + (1 << 63)) if len(rows) > 1 else []
    return [(apart[a], apart[b]) for a, b in found]


def _candidates(rows: list[tuple], bucket: int, percent: int) -> list[tuple[int, int]]:
    """(class, bucket) of the classes that are to be compared whole."""
    if len(rows) < 2:
        return []
    keep = paired([r[1] for r in rows], np.array([r[3] for r in rows]), percent, bucket + (1 << 63))
    return [(r[0], bucket) for r, k in zip(rows, keep.tolist(), strict=True) if k]


def _meetings(percent: int, meet):
    """Rows sorted by (bucket, block): each run of equal ones is a meeting, of each class once."""

    def run(batches):
        key, rows, out = None, {}, []

        def met() -> list[tuple[int, int]]:
            return meet(sorted(rows.values(), key=lambda r: (r[3], r[0])), key[0], percent) if rows else []

        def batch():
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["class", "root"])

        for b in batches:
            for bucket, block, cls, grams, comp, size in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (bucket, block) != key:
                    out += met()
                    key, rows = (bucket, block), {}
                rows[cls] = (cls, np.frombuffer(grams, np.uint64), comp, size)
            if out:
                yield batch()
                out.clear()
        out += met()
        yield batch()

    return run


def _meet(rows: DataFrame, percent: int, meet) -> DataFrame:
    """``rows``: bucket, block, class, grams, comp, size."""
    return (rows.select("bucket", "block", "class", "grams", "comp", F.col("size").cast("long")).repartition("bucket", "block")
            .sortWithinPartitions("bucket", "block").mapInArrow(lean(_meetings(percent, meet)), "class long, root long"))


def _packed(batches):
    """Lists of signed keys as ordered unsigned key arrays."""
    for b in batches:
        lists = b.column(1)
        keys = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        grams = [np.sort(keys[a:e]).tobytes() for a, e in zip(np.append(0, ends[:-1]), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary()), b.column(2)], ["class", "grams", "size"])


def _paired_blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt to pairs of their bucket's ``blocks``, so that any two meet."""
    mine = F.pmod(F.xxhash64("class"), "blocks")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(mine, k) * F.col("blocks") + F.greatest(mine, k))
    return rows.withColumn("block", F.explode(pairs)).drop("blocks")


def _blocks(members: Column, grams: Column, sets: int, most: int) -> Column:
    return F.greatest(F.ceil(members / sets), F.ceil(grams / most)).cast("long")


def jaccard_classes(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text",
                    block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS, heavy_grams: int = HEAVY,
                    most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, text_key, size, class), (class, component class) of classes that met any other."""
    rows = key_and_text(docs, key, text).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("text").cast("binary").alias("text"))
    table = rewritten(rows.mapInArrow(lean(_summaries(n)), "doc_id long, text_key long, size long, class long"), "sets")
    top = (table.where("class IS NULL").groupBy("text_key").agg(F.sum("size").alias("times"))
           .orderBy(F.desc("times"), "text_key").limit(heavy_grams).collect())
    order = sorted((r.times, r.text_key & ((1 << 64) - 1)) for r in top)
    heavy = np.array([g for _, g in order], np.uint64)
    by_gram = np.argsort(heavy)
    heavy, rank = heavy[by_gram], by_gram.astype(np.uint64)
    documents = table.where("class IS NOT NULL")

    # Prefix n-grams that two classes or more share.
    prefixes = rows.select("text").mapInArrow(lean(_prefixes(n, percent, heavy, rank)), "gram long, class long, size int, spread short")
    alike = Window.partitionBy("gram", "spread")
    shared = rewritten(prefixes.select("*", F.min("class").over(alike).alias("low"), F.max("class").over(alike).alias("high"))
                       .where((F.col("low") != F.col("high")) | (F.col("spread") >= 0)).select("gram", "class", "size").distinct(), "shared")
    # A set that links shares ``shared_least`` of its prefix n-grams.  Sets that do not drop out,
    # and with them n-grams of a single class that is left; twice, as that can drop more.
    need = F.ceil(F.lit(percent) * F.col("size") / 100)
    least = F.greatest(F.lit(1), F.least(F.floor((F.col("size") - need + 1) / MORE), need - 1)) if percent >= 50 else F.lit(1)
    for _ in range(2):
        enough = shared.groupBy("class", "size").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("class")
        left = shared.join(enough, "class")
        several = left.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("gram")
        shared = rewritten(left.join(several, "gram").select("gram", "class", "size"), "shared")

    # Buckets: n-grams with the same members are one, named by the first of them as a signed
    # number in the global order.  By the shared prefixes alone, which are few, classes are found
    # that may have a partner in a bucket; only they go on, and bring their sets.
    flipped = F.col("gram").bitwiseXOR(F.lit(-(1 << 63))).alias("bucket")
    of_gram = shared.groupBy("gram").agg(F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high"),
                                         F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sign"))
    buckets = of_gram.groupBy("members", "low", "high", "sign").agg(F.min(flipped).alias("bucket")).select("bucket", "members")
    inside = shared.select(flipped, "class", "size").join(buckets.select("bucket", F.ceil(2 * F.col("members") / block_sets).alias("blocks")), "bucket")
    prefix = rewritten(shared.groupBy("class", "size").agg(F.collect_list("gram").alias("grams")).select("class", "grams", F.col("size").cast("long"))
                       .mapInArrow(lean(_packed), "class long, grams binary, size long"), "prefixes")
    met = _meet(_paired_blocks(inside).join(prefix.drop("size"), "class").withColumn("comp", F.lit(0).cast("long")), percent, _candidates)
    partners = rewritten(met.select("class", F.col("root").alias("bucket")).distinct().join(inside.select("class", "bucket", "size"), ["class", "bucket"]), "partners")

    # First meeting: one bucket for each class.
    each = partners.groupBy("bucket").agg(F.count("*").alias("members"))
    chosen = rewritten(partners.join(each, "bucket").groupBy("class").agg(F.max(F.struct("members", "bucket")).alias("m"), F.max("size").alias("size"))
                       .select("class", F.col("m.bucket").alias("bucket"), "size"), "chosen")
    one = documents.where("size > 0").groupBy("class").agg(F.min(F.struct("text_key", "doc_id")).alias("of"))
    wanted = rewritten(chosen.select("class").join(one, "class").select("class", F.col("of.text_key").alias("text_key"), F.col("of.doc_id").alias("d")), "wanted")
    wanted = broadcast_if_small(wanted, most_broadcast)
    of_text = rows.join(wanted, (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(wanted["d"])).select("class", "text")
    sets = rewritten(of_text.mapInArrow(lean(_sets(n, heavy, rank)), "class long, grams binary").dropDuplicates(["class"]), "grams")

    component, left = None, chosen
    while True:
        load = left.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("size").alias("grams"))
        cut = left.join(load.select("bucket", _blocks(F.col("members"), F.col("grams"), block_sets, block_grams).alias("blocks")), "bucket")
        cut = rewritten(cut.select("class", "bucket", "size", "blocks", F.pmod(F.xxhash64("class"), "blocks").alias("block")), "dealt")
        met = rewritten(_meet(cut.join(sets, "class").withColumn("comp", F.lit(0).cast("long")), percent, _rooted), "met")
        component = met if component is None else rewritten(
            component.join(met.select(F.col("class").alias("root"), F.col("root").alias("next")), "root", "left").select("class", F.coalesce("next", "root").alias("root")), "met")
        again = rewritten(cut.where("blocks > 1").join(met.where("class = root").select("class"), "class").select("class", "bucket", "size"), "again")
        # Blocks that merged nothing will not do so again: the last step compares them.
        if again.isEmpty() or again.count() == left.count():
            break
        left = again

    # Buckets whose classes are in different components still.
    marked = partners.join(component, "class")
    split = (marked.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("size").alias("grams"))
             .where("low != high").select("bucket", _blocks(F.col("members"), F.col("grams"), block_sets // 2, block_grams // 2).alias("blocks")))
    rest = _paired_blocks(marked.select("bucket", "class", "size", F.col("root").alias("comp")).join(split, "bucket"))
    links = rewritten(_meet(rest.join(sets, "class"), percent, _bridges), "links")
    merged = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    final = component.join(merged.select(F.col("node").alias("root"), "component"), "root", "left").select("class", F.coalesce("component", "root").alias("component"))
    return documents, rewritten(final, "classes")


def _named(docs: DataFrame, n: int, percent: int, key: str, text: str, **limits) -> tuple[DataFrame, DataFrame]:
    """(documents, those with words and their component's class)."""
    documents, classes = jaccard_classes(docs, n, percent, key, text, **limits)
    named = documents.where("size > 0").join(classes, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return documents, named.select("doc_id", "size", "text_key", "component")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id that links reach), text_key."""
    documents, named = _named(docs, n, percent, key, text, **limits)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id", "text_key")
    empty = documents.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key")
    return out.unionByName(empty)


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The documents, of each component only the one with the least key (then the least
    hash of its text; nulls last); of rows that repeat key and text one stays.  Documents
    without words stay."""
    _, named = _named(docs, n, percent, key, text, **limits)
    named = rewritten(named, "named")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    groups = named.groupBy("component").agg(F.count("*").alias("members"), F.min(own).alias("first")).where("members > 1")
    # Rows in groups of several: to drop, or (the first, if it is repeated) to keep once.
    marked = named.join(groups, "component").withColumn("stays", own == F.col("first"))
    marked = marked.groupBy("doc_id", "text_key").agg(F.first("stays").alias("stays"), F.count("*").alias("times"))
    marked = rewritten(marked.where("NOT stays OR times > 1").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "stays"), "marked")
    rows = docs.select(F.struct("*").alias("row"), docs[key].cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_key"))
    few = broadcast_if_small(marked, limits.get("most_broadcast", MOST_BROADCAST))
    met = rows.join(few, (rows["text_key"] == few["t"]) & rows["doc_id"].eqNullSafe(few["d"]), "left").where("stays IS NULL OR stays")
    if marked.where("stays").isEmpty():
        return met.select("row.*")
    return one_of_repeats(met.select("row", "stays", "doc_id", "text_key"), F.col("stays").isNotNull(), [F.col("doc_id"), F.col("text_key")]).select("row.*")
