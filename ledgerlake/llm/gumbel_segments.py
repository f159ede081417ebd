"""SentencePiece segmentations by Gumbel top-k without replacement.

The public model gives pieces and scores; its lattice holds every way to part
the normalised text (blanks become ``▁``, one is put in front) into pieces,
with byte pieces for characters that have none.  A segmentation's weight is the
product of its pieces' chances to the power ``alpha``, a piece's chance being
1 / (merge rank + 1): the model is of the BPE kind, whose scores are ranks.

Drawing k segmentations without replacement takes the k largest of all
Gumbel-perturbed log probabilities.  They are found top-down: the perturbed
maximum of everything is drawn first and handed down the branch that attains it
(chosen by backward sums over the lattice); what else could have been taken
at each step is one open branch, with a perturbed maximum of its own, truncated at
its parent's.  A best-first search over open branches (an A* search whose
bound is exact) then completes the best one k times.  With the next best as
threshold t, a segmentation with log probability q was included with chance
1 - exp(-exp(q - t)).

Speed: no piece spans the change from another character to ``▁``, so words are
lattices of their own; backward sums and steps run in numpy over all words of
a batch at once, equal words share a lattice, which is kept for later batches.  Random numbers are hashes of (seed,
row key, place), so a row's result depends on neither its batch nor its task.
One narrow map, no shuffle.

Defined cases: null and empty texts have one segmentation, the empty one, with
chance 1 (log 0); a text with fewer than k segmentations gives all it has; rows that
repeat a key draw alike; a null key draws like key 0; very long texts are
one lattice chain, never cut; an empty table gives no rows; extra columns play no
part.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import hashed_words
from .common import key_and_text, lean
from .tokens import tokenizer_path

MODEL_FILE = "piece_bpe_32k.model"
SAMPLES = 3
ALPHA = 1.0
SEED = 17
#: Bytes of text that a worker handles at once (a longer text is a batch of its own).
BATCH_BYTES = 3_000_000
BLANK = "▁"
#: Edges of the lattices that a worker keeps from batch to batch.
MOST_EDGES = 4_000_000
#: No perturbation of a chance in (0, 1) with 53 bits exceeds this.
HIGHEST = 38.0
#: Steps of a path, and texts, whose branches are looked at together.
STEPS, TEXTS = 384, 128
SCHEMA = "doc_id long, sample int, n_pieces long, ids_crc32 long, text_crc32 long, log_prob double, log_inclusion double"
_M = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: A word's counters are this far from the next word's: 2^20 steps.
_WORD = np.uint64((0x9E3779B97F4A7C15 << 20) & ((1 << 64) - 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed counters."""
    return ((_mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Pieces:
    """The model's pieces as a trie in an open-addressed table, and its decoder."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_from = sp.piece_to_id("<0x00>")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = np.full(n, float(n))
        for i in plain:
            rank[i] = min(-sp.get_score(i), n) if sp.get_score(i) > -n else n
        self.log_prob = -np.log1p(np.maximum(rank, 0)) * alpha
        self.text = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.text[i] = bytes([i - self.bytes_from])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.text[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
        self.text_size = np.array([len(t) for t in self.text])
        self.text_from = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(self.text), np.uint8)
        letters = sorted({c for i in plain for c in sp.id_to_piece(i)})
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        step: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for i in plain:
            piece = sp.id_to_piece(i)
            if BLANK in piece.lstrip(BLANK):
                raise ValueError("a piece spans a blank: words are not lattices of their own")
            node = 0
            for c in self.letter[[ord(c) for c in piece]].tolist():
                if (node, c) not in step:
                    step[node, c] = len(self.piece)
                    self.piece.append(-1)
                node = step[node, c]
            self.piece[node] = i
        self.piece = np.array(self.piece)
        self.wide = len(letters) + 1
        size = 1 << (4 * len(step) - 1).bit_length()
        self.mask = np.int64(size - 1)
        keys, values = [-1] * size, [0] * size
        for (node, c), to in step.items():
            key = node * self.wide + c
            at = int(self._slot(np.array([key]))[0])
            while keys[at] >= 0:
                at = (at + 1) & (size - 1)
            keys[at], values[at] = key, to
        self.keys, self.values = np.array(keys), np.array(values)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * _M[2]
        return (x >> np.uint64(40)).astype(np.int64) & self.mask

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The trie's next nodes, 0 where there is none."""
        key = node * self.wide + letter
        at = self._slot(key)
        out = np.zeros(len(key), np.int64)
        left = None
        while True:
            have = self.keys[at]
            hit = have == key if left is None else have == key[left]
            if left is None:
                out[hit] = self.values[at[hit]]
                left = np.flatnonzero(~hit & (have >= 0))
                at = (at[left] + 1) & self.mask
            else:
                out[left[hit]] = self.values[at[hit]]
                go = ~hit & (have >= 0)
                left, at = left[go], (at[go] + 1) & self.mask
            if not len(left):
                return out

    def decoded_all(self, parts: list[np.ndarray]) -> list[bytes]:
        """The texts of several id arrays in UTF-8, without the blank put in front; some
        hundred thousand ids at a time."""
        out: list[bytes] = []
        at = 0
        while at < len(parts):
            to, n = at, 0
            while to < len(parts) and (to == at or n + len(parts[to]) <= 300_000):
                n += len(parts[to])
                to += 1
            ids = np.concatenate(parts[at:to])
            size = self.text_size[ids]
            ends = np.append(0, np.cumsum(size))
            raw = self.text_flat[np.arange(ends[-1]) + np.repeat(self.text_from[ids] - ends[:-1], size)].tobytes()
            cut = ends[np.cumsum([0, *map(len, parts[at:to])])].tolist()
            out += [raw[a + (raw[a:a + 1] == b" "):b] if a < b else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]
            at = to
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decoded_all([np.array(ids, np.int64)])[0].decode(errors="replace")


def words_of(text: str | None) -> list[str]:
    """The words of the normalised text, cut before each blank that follows another
    character; of a word's leading blanks the first is left out."""
    if not text:
        return []
    parts = (text.replace(BLANK, " ") if BLANK in text else text).split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], -1
    for p in parts:
        blanks += 1
        if p:
            out.append(BLANK * blanks + p)
            blanks = -1
    return [*out, BLANK * blanks] if blanks >= 0 else out


class Lattices:
    """The lattices of distinct words, end to end: edges by their first position,
    their normalised log chances and backward sums."""

    def __init__(self, pieces: Pieces, words: list[str]):
        # Each word's positions, and one behind it where its chains end.
        code = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64) + 1
        last = np.cumsum(size) - 1
        self.first = last + 1 - size
        self.is_end = np.zeros(len(code), bool)
        self.is_end[last] = True
        at = np.arange(len(code))
        away = np.repeat(last, size) - at
        letter = pieces.letter[code]
        letter[last] = 0
        found = []
        inner = np.flatnonzero(~self.is_end)
        node, here, depth = np.zeros(len(inner), np.int64), inner, 0
        edges = np.zeros(len(code), np.int64)  # of each position
        known = self.is_end.copy()
        while len(here):
            node = pieces.step(node, letter[here + depth])
            go = node > 0
            here, node = here[go], node[go]
            depth += 1
            piece = pieces.piece[node]
            hit = piece >= 0
            if depth == 1:
                known[here[hit]] = True
            found.append((here[hit], piece[hit]))
            edges[here[hit]] += 1
            go = away[here] > depth
            here, node = here[go], node[go]
        # Characters without a piece are spelled in bytes.
        odd = at[~known]
        edges[odd] += 1
        # Positions by their distance from the word's end, so that sums go backward level by level;
        # each position's edges are a run, longer pieces first.
        few = away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away  # sorts by radix
        order = np.argsort(few, kind="stable")[len(words):]
        self.many = edges[order]
        ends = np.cumsum(self.many)
        self.begins = ends - self.many
        self.single = np.repeat(self.many == 1, self.many)
        self.edge = np.zeros(len(code), np.int64)  # of each position the first, and the last
        self.edge[order] = self.begins
        total_edges = int(ends[-1])
        self.stop, self.piece = np.empty(total_edges, np.int64), np.empty(total_edges, np.int64)
        fill = self.edge.copy()
        for depth in range(len(found), 0, -1):
            here, piece = found.pop()
            slot = fill[here]
            self.stop[slot], self.piece[slot] = here + depth, piece
            fill[here] += 1
        slot = fill[odd]
        fill[odd] += 1
        self.last = fill - 1
        # A character of one byte is that byte's piece; below 0: the character to spell.
        self.stop[slot], self.piece[slot] = odd + 1, np.where(code[odd] < 0x80, pieces.bytes_from + code[odd], -1 - code[odd])
        value = pieces.log_prob[np.maximum(self.piece, 0)]
        if len(odd):
            spelled = 1 + (code[odd] > 0x7F) + (code[odd] > 0x7FF) + (code[odd] > 0xFFFF)
            value[slot] = spelled * pieces.log_prob[pieces.bytes_from]
        chance = np.empty_like(value)
        total = np.zeros(len(code))  # backward sum of each position; 0 behind a word
        level = np.append(np.flatnonzero(np.diff(away[order], prepend=0)), len(order))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            x, y = int(self.begins[a]), int(ends[b - 1])
            v = value[x:y]
            v += total[self.stop[x:y]]
            seg, many = self.begins[a:b] - x, self.many[a:b]
            top = np.maximum.reduceat(v, seg)
            v -= np.repeat(top, many)
            np.exp(v, out=chance[x:y])
            z = np.add.reduceat(chance[x:y], seg)
            log_z = np.log(z)
            total[order[a:b]] = top + log_z
            v -= np.repeat(log_z, many)
            chance[x:y] /= np.repeat(z, many)
        self.log = value
        # Running sums of the chances, from each run's begin.
        sums = np.cumsum(chance)
        sums -= np.repeat(sums[self.begins] - chance[self.begins], self.many)
        self.sums = sums

    def more(self, new: Lattices) -> None:
        """Adds the lattices of further words behind these."""
        positions, edges = len(self.is_end), len(self.log)
        for name, by in (("first", positions), ("is_end", None), ("many", None), ("begins", edges), ("single", None), ("edge", edges), ("last", edges),
                         ("stop", positions), ("piece", None), ("log", None), ("sums", None)):
            part = getattr(new, name)
            if by:
                part += by
            setattr(self, name, np.concatenate([getattr(self, name), part]))
            delattr(new, name)

    def run_of(self, edge: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, edge, "right") - 1

    def other(self, edge: np.ndarray) -> np.ndarray:
        """Log chance of what a position has besides an edge; nothing if it is its only one, whatever rounding says."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.single[edge], -np.inf, np.log(-np.expm1(np.minimum(self.log[edge], 0))))

    def choose(self, position: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each position by its chance: walks along each run."""
        edge, last = self.edge[position], self.last[position]
        left = np.flatnonzero((self.sums[edge] <= u) & (edge < last))
        while len(left):
            edge[left] += 1
            e = edge[left]
            left = left[(self.sums[e] <= u[left]) & (e < last[left])]
        return edge

    def walk(self, positions: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each position on to its word's end: the edges in order, and how many of each."""
        n = len(positions)
        if not n:
            return np.empty(0, np.int64), np.zeros(0, np.int64)
        taken, who = [], []
        here, at, step = positions, np.arange(n), 0
        while len(at):
            edge = self.choose(here, _uniform(seeds + np.uint64(step) * _M[2]))
            taken.append(edge)
            who.append(at)
            to = self.stop[edge]
            go = np.flatnonzero(~self.is_end[to])
            at, here, seeds = at[go], to[go], seeds[go]
            step += 1
        counts = np.bincount(np.concatenate(who), minlength=n)
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[first] = taken[0]
        for step in range(1, len(who)):
            out[first[who[step]] + step] = taken[step]
        return out, counts


class Draw:
    """One document's search: paths drawn so far and the open branches."""

    def __init__(self, seed: np.uint64):
        self.seed, self.paths, self.open = seed, [], []

    def further(self, lattices: Lattices, k: int, edges: np.ndarray, log: np.ndarray, top: float, mine: list[tuple], before: float, at: int, most: int) -> list[tuple]:
        """The ``most`` best open branches of a path, of those in ``mine`` and of the steps from ``at`` on."""
        n, least = len(self.paths) - 1, mine[-1][0] if len(mine) == most else -np.inf
        while at < len(edges) and before + HIGHEST >= least:
            some = slice(at, at + STEPS)
            ahead = before + np.cumsum(log[some]) - log[some]
            u = _uniform(self.seed + np.uint64(2 * k + 2) * _M[2] + np.arange(at, at + len(ahead), dtype=np.uint64) * _M[3])
            peak = truncated(ahead + lattices.other(edges[some]), top, u)
            best = (np.argpartition(peak, len(peak) - most)[-most:] if len(peak) > most else np.arange(len(peak))).tolist()
            mine += [(float(peak[t]), n, at + t, (int(edges[at + t]),)) for t in best if peak[t] > -np.inf]
            mine = sorted(mine, reverse=True)[:most]
            least = mine[-1][0] if len(mine) == most else -np.inf
            before, at = float(ahead[-1] + log[some][-1]), at + STEPS
        return mine


def add(lattices: Lattices, k: int, drawn: list[tuple], most: int) -> None:
    """Drawn paths, one of each text: (draw, edges, words, top, kept), where ``words(n)`` gives the words of the first n steps.
    A path's steps from ``kept`` on leave open branches, of which the ``most`` best can matter.

    A perturbation raises a branch by ``HIGHEST`` at most, as chances have 53
    bits; steps so unlikely that this cannot reach the best are not looked at.  The first ``STEPS`` steps of ``TEXTS`` texts are looked at together."""
    for x in range(0, len(drawn), TEXTS):
        some = drawn[x:x + TEXTS]
        size = np.array([len(edges) for _, edges, *_ in some])
        end = np.cumsum(size)
        kept = np.array([kept for *_, kept in some])
        every = np.concatenate([edges for _, edges, *_ in some])
        log = lattices.log[every]
        logs = [log[b - n:b] for n, b in zip(size.tolist(), end.tolist(), strict=True)]
        before = np.array([float(own[:m].sum()) for own, m in zip(logs, kept.tolist(), strict=True)])
        for (draw, edges, words, top, _), own in zip(some, logs, strict=True):
            draw.paths.append((edges, words, float(own.sum()), top))
        # A row for each text.
        looked = np.minimum(size - kept, STEPS)
        wide = int(looked.max())
        if not wide:
            continue
        step = np.arange(wide)
        there = step < looked[:, None]
        place = np.where(there, (end - size + kept)[:, None] + step, 0)
        here = np.where(there, log[place], 0.0)
        ahead = before[:, None] + np.cumsum(here, axis=1) - here
        seeds = np.array([draw.seed for draw, *_ in some]) + np.uint64(2 * k + 2) * _M[2] + kept.astype(np.uint64) * _M[3]
        u = _uniform(seeds[:, None] + step.astype(np.uint64) * _M[3])
        peak = truncated(ahead + lattices.other(every[place]), np.array([top for *_, top, _ in some])[:, None], u)
        peak[~there] = -np.inf
        best = np.argpartition(peak, wide - most, axis=1)[:, -most:] if wide > most else np.broadcast_to(step, peak.shape)
        peaks = np.take_along_axis(peak, best, 1).tolist()
        taken = every[np.take_along_axis(place, best, 1)].tolist()
        for r, (draw, edges, _, top, m) in enumerate(some):
            n = len(draw.paths) - 1
            mine = sorted([(p, n, m + t, (e,)) for p, t, e in zip(peaks[r], best[r].tolist(), taken[r], strict=True) if p > -np.inf], reverse=True)[:most]
            if m + STEPS < len(edges):
                mine = draw.further(lattices, k, edges, logs[r], top, mine, float(ahead[r, -1] + here[r, -1]), m + STEPS, most)
            draw.open += mine


def truncated(location, top, u):
    """Gumbel numbers at ``location`` given that they are below ``top``."""
    return location - np.log(np.exp(np.minimum(location - top, 700)) - np.log(u))


@np.errstate(over="ignore")
def draws(pieces: Pieces, keys: list[int | None], texts: pa.Array, samples: int, seed: int = SEED, words: Words | None = None) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
    """Of each text: (ids, log chance, perturbed log chance) of its segmentations, best first; and the threshold.  ``words``
    keeps lattices from one call to the next."""
    words = words or Words()
    of = words.numbered(texts)
    if not any(map(len, of)):
        return [([(np.empty(0, np.int64), 0.0, 0.0)], -np.inf) for _ in keys]
    lat = words.with_lattices(pieces)
    seeds = _mixed(np.array([(k or 0) & ((1 << 64) - 1) for k in keys], np.uint64) + np.uint64(seed) * _M[2])
    state = [Draw(s) for s in seeds]

    def walk(jobs: list[tuple[int, np.ndarray, int]], k: int) -> list[tuple]:
        """(text, positions, first word) each: edges, and their words as a function."""
        if not jobs:
            return []
        where = np.concatenate([p for _, p, _ in jobs])
        own = np.concatenate([np.arange(first, first + len(p), dtype=np.uint64) * _WORD + (seeds[d] + np.uint64(k + 1) * _M[0]) for d, p, first in jobs])
        edges, counts = lat.walk(where, own)
        ends = np.append(0, np.cumsum(counts))
        out, at = [], 0
        for _, p, first in jobs:
            c = counts[at:at + len(p)]
            words = lambda n, c=c, first=first: np.repeat(np.arange(first, first + min(n, len(c))), c[:n])[:n]
            out.append((edges[ends[at]:ends[at + len(p)]], words))
            at += len(p)
        return out

    jobs = [(d, lat.first[words], 0) for d, words in enumerate(of) if len(words)]
    tops = -np.log(-np.log(_uniform(seeds + _M[3])))
    add(lat, 0, [(state[d], edges, words, float(tops[d]), 0) for (d, *_), (edges, words) in zip(jobs, walk(jobs, 0), strict=True)], samples)
    for k in range(1, samples):
        jobs, heads = [], []
        for d, s in enumerate(state):
            if not s.open or len(s.paths) < k:
                continue
            best = max(range(len(s.open)), key=lambda b: s.open[b][0])
            peak, path, at, gone = s.open.pop(best)
            edges, words, _, _ = s.paths[path]
            run = int(lat.run_of(edges[at]))
            begin = int(lat.begins[run])
            choice = np.array([e for e in range(begin, begin + int(lat.many[run])) if e not in gone])
            log = lat.log[choice]
            chance = np.cumsum(np.exp(log - log.max()))
            u = _uniform(np.array([s.seed + np.uint64(2 * k + 1) * _M[1], s.seed + np.uint64(2 * k + 1) * _M[0]]))
            pick = min(int(np.searchsorted(chance, u[0] * chance[-1], "right")), len(choice) - 1)
            e = int(choice[pick])
            if len(choice) > 1:
                place = float(lat.log[edges[:at]].sum() + np.logaddexp.reduce(log[np.arange(len(log)) != pick]))
                s.open.append((float(truncated(place, peak, u[1])), path, at, (*gone, e)))
            head_words = words(at + 1)
            w = int(head_words[at])
            stop = int(lat.stop[e])
            positions = lat.first[of[d][w + 1:]]
            inside = not lat.is_end[stop]
            if inside:
                positions = np.append(stop, positions)
            heads.append((d, np.append(edges[:at], e), head_words, peak, at))
            jobs.append((d, positions, w if inside else w + 1))
        drawn = []
        for (d, head, head_words, peak, at), (edges, words) in zip(heads, walk(jobs, k), strict=True):
            both = lambda n, a=head_words, b=words: a[:n] if n <= len(a) else np.append(a, b(n - len(a)))
            drawn.append((state[d], np.concatenate([head, edges]), both, peak, at + 1))
        add(lat, k, drawn, samples)
    paths = [[(np.empty(0, np.int64), None, 0.0, 0.0)] if not len(words) else s.paths for words, s in zip(of, state, strict=True)]
    flat = iter(ids_of(pieces, [lat.piece[e] for own in paths for e, *_ in own]))
    return [([(next(flat), q, top) for *_, q, top in own], max((b[0] for b in s.open), default=-np.inf)) for own, s in zip(paths, state, strict=True)]


class Words:
    """Numbers of distinct words, with their lattices, over several batches: common words are built once.
    Beyond ``MOST_EDGES`` edges it begins anew."""

    def __init__(self):
        self.lattices: Lattices | None = None
        self.clear()

    def clear(self) -> None:
        self.table, self.lattices = hashed_words.Table(), None
        self.number = np.empty(0, np.int64)  # of the table's words
        self.odd: dict[str, int] = {}
        self.size, self.new = 0, []

    def numbered(self, texts: pa.Array) -> list[np.ndarray]:
        """The numbers of each text's words; ``new`` are those without a lattice yet."""
        if self.lattices is not None and len(self.lattices.log) > MOST_EDGES:
            self.clear()
        of: list[np.ndarray] = []
        for _, n, data, offsets in hashed_words.chunks(texts, 1 << 62):
            blanks = np.flatnonzero(data == 0x20)
            starts, ends, words = hashed_words.cut(data, offsets, blanks)
            row = np.repeat(np.arange(n), words)
            # Texts with runs of blanks, or the blank's own sign, are cut one by one.
            odd = np.bincount(row, starts == ends, n) > 0
            sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            odd[np.searchsorted(offsets, sign, "right") - 1] = True
            hashes = hashed_words.hashes(data, starts, ends)
            found = self.table.find(hashes)
            raw = data.tobytes()
            lack = np.flatnonzero(found < 0)
            if len(lack):
                key, which, back = np.unique(hashes[lack], return_index=True, return_inverse=True)
                found[lack] = self.table.add(key)[back]
                which = lack[which]
                self.number = np.append(self.number, np.arange(self.size, self.size + len(key)))
                self.new += [raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
                self.size += len(key)
            numbers = self.number[found]
            begin = np.append(0, np.cumsum(words))
            for k in range(n):
                if odd[k]:
                    of.append(np.array([self._odd(w) for w in words_of(raw[offsets[k]:offsets[k + 1]].decode())], np.int64))
                else:
                    of.append(numbers[begin[k]:begin[k + 1]])
        return of

    def _odd(self, word: str) -> int:
        if word not in self.odd:
            self.odd[word] = self.size
            self.new.append(word)
            self.size += 1
        return self.odd[word]

    def with_lattices(self, pieces: Pieces) -> Lattices:
        if self.new:
            built = Lattices(pieces, [BLANK + w for w in self.new])
            if self.lattices is None:
                self.lattices = built
            else:
                self.lattices.more(built)
            self.new = []
        return self.lattices


def numbered(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some texts, and the numbers of each text's words."""
    words = Words()
    of = words.numbered(texts)
    return words.new, of


def ids_of(pieces: Pieces, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Model ids of several paths; characters to spell become their bytes' pieces."""
    out = []
    for piece in parts:
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            some, last = [], 0
            for k in odd.tolist():
                raw = chr(-1 - int(piece[k])).encode()
                some += [piece[last:k], np.array([pieces.bytes_from + b for b in raw])]
                last = k + 1
            piece = np.concatenate([*some, piece[last:]])
        out.append(piece)
    return out


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Log chance that a segmentation passes the threshold."""
    x = log_prob - threshold
    return 0.0 if x > 30 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


_PIECES: dict[tuple[str, float], Pieces] = {}


def _pieces(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


def _segmenter(path: str, samples: int, alpha: float, seed: int, with_ids: bool):
    names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        pieces, words = _pieces(path, alpha), Words()
        for b in batches:
            size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + BATCH_BYTES, "right")) - 1)
                keys, rows = b.column(0).slice(at, to - at).to_pylist(), []
                drawn = draws(pieces, keys, b.column(1).slice(at, to - at), samples, seed, words)
                texts = iter(pieces.decoded_all([ids for paths, _ in drawn for ids, _, _ in paths]))
                for key, (paths, threshold) in zip(keys, drawn, strict=True):
                    for k, (ids, q, _) in enumerate(paths):
                        row = [key, k, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(next(texts)), q, log_inclusion(q, threshold)]
                        rows.append(row + [ids.tolist()] * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                at = to

    return run


def segmentations(docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text", path: str | None = None, alpha: float = ALPHA,
                  seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Per row and sample: doc_id, sample (0 is the best), n_pieces, ids_crc32, text_crc32 (of the
    decoded text), log_prob, log_inclusion; ``with_ids`` adds the ids."""
    run = _segmenter(path or tokenizer_path(MODEL_FILE), samples, alpha, seed, with_ids)
    return key_and_text(docs, key, text).mapInArrow(lean(run), SCHEMA + ", ids array<int>" * with_ids)
