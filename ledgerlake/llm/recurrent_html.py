"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with
the path of its open tags (names, class and id words).  A bidirectional LSTM
in numpy reads the page's sequence of blocks.  Its input per block is the mean
of hashed tag-path vectors, the mean of hashed word vectors and a few figures;
its output is the chance that the block belongs to the main text, judged with
the context of the whole page.

Training: pages carry no labels, so a bounded sample (``TRAIN_PAGES`` pages, those
with the least hash of their markup) is labelled by its semantic tags, and each page is
also shown with its wrappers renamed and further side blocks put in, so that
the labeller does not hang on one tag name.  Training runs on the driver; the
weights (about 200 KB) go to the tasks, which label all pages, in batches of
similar length.  No shuffle is needed after training.

Scripts, styles, templates, frames, text areas and the page's title are skipped; all else,
formulas, drawings and fallback texts too, is text for the labeller to judge.  An
element that is not closed ends with its parent.

Defined cases: null or empty html gives an empty text; a page without any main
block too; cut-off pages are read as far as they go; repeated rows are
labelled alike; extra columns play no part; without any page to train on the
semantic tags decide.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 240
TRAIN_CHARS = 200_000
EPOCHS = 5
SEED = 11
#: Pages times blocks that are labelled together (some 260 bytes each).
CELLS = 200_000
PATH_ROWS, WORD_ROWS = 2048, 4096
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 12, 6, 6, 16

#: HTML element kinds (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot"
    " th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is skipped (a title inside svg is text).
RAW_TAGS = frozenset("script style template textarea iframe title".split())
#: Elements that an opening tag of the same group ends.
_SIBLINGS = {t: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>"']+|"[^"]*"|'[^']*')*+|[^<>]*)>?|<[!?][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
Block = tuple[str, tuple[str, ...], int]


def blocks(page: str) -> list[Block]:
    """(text, path, characters in links) of each leaf block that has text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    unclosed: set[str] = set()  # names without an end tag from here on

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, tuple(x for _, names in stack for x in names), linked))
            parts.clear()
        linked = 0

    def end_tag(name: str) -> re.Match | None:
        if name in unclosed:
            return None
        end = re.compile(f"</{re.escape(name)}(?![^\\s/>])[^>]*>?", re.I).search(page, at)
        if not end:
            unclosed.add(name)
        return end

    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at:m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCK_TAGS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            close()
            own = _SIBLINGS.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and name not in ("button", "noscript") or stack[k][0] in own:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if name in RAW_TAGS and not (name == "title" and any(x == "svg" for x, _ in stack)) and not m[3].endswith("/"):
            if end := end_tag(name):
                at = end.end()
            else:  # it ends with the first parent that is closed
                at = next((end.start() for x, _ in reversed(stack) if (end := end_tag(x))), len(page))
        elif name not in VOID_TAGS and not m[3].endswith("/"):
            words = [w for a in _ATTRIBUTE.findall(m[3]) for w in _NAME.findall(a.lower())] if m[3] else []
            stack.append((name, (name, *words)))
            in_link += name == "a"
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _hash(word: str, rows: int) -> int:
    return zlib.crc32(word.encode()) % rows


def features(page: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed path rows, hashed word rows and figures of each block."""
    paths, words = [], []
    figures = np.zeros((len(page), FIGURES), np.float32)
    for k, (text, path, linked) in enumerate(page):
        paths.append(np.array([_hash(x, PATH_ROWS) for x in path] or [0]))
        found = _WORD.findall(text.lower())
        words.append(np.array([_hash(w, WORD_ROWS) for w in found] or [0]))
        n = len(text)
        figures[k] = (np.log1p(n) / 8, np.log1p(len(found)) / 6, min(1, linked / max(1, n)), text[-1] in ".!?:;\"”»", text.count("|") * 10 / (n + 10), k / len(page))
    return paths, words, figures


#: Names that say what a part of a page is (fixed values).
MAIN_NAMES = ("article", "main")
SIDE_NAMES = frozenset(
    "nav navbar navigation menu header footer aside sidebar ad ads advert advertisement banner promo sponsored cookie cookies consent notice"
    " alert form comment comments reply respond discussion share social related breadcrumb breadcrumbs pagination newsletter subscribe"
    " widget head button select login search".split())


def semantic_labels(page: list[Block]) -> np.ndarray:
    """1 in an article or main part, but not in one of its side parts."""
    anywhere = any(set(path) & set(MAIN_NAMES) for _, path, _ in page)
    return np.array([(not anywhere or bool(set(path) & set(MAIN_NAMES))) and not set(path) & SIDE_NAMES for _, path, _ in page], np.float32)


def varied(page: list[Block], labels: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page with other wrappers, and with side blocks as such pages have them."""
    main = rng.choice([("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post", "body"), ("section", "entry", "content"),
                       ("div", "article", "body"), ("div", "main"), ("div", "story"), ("td",)])
    out, marks = [], []
    pool = [t for t, _, _ in page] or ["text"]

    def side(path: tuple[str, ...], n: int, linked: float) -> None:
        for _ in range(n):
            words = rng.choice(pool).split()
            at = rng.randrange(len(words))
            text = " ".join(words[at:at + rng.randrange(1, 25)])
            out.append((text, path, int(len(text) * linked)))
            marks.append(0)

    wrap = ("html", "body")
    if rng.random() < 0.5:
        side((*wrap, *rng.choice([("header",), ("div", "header"), ("div", "navbar"), ("ul", "menu", "li"), ("div", "cookie", "notice"), ("div", "breadcrumb")])), rng.randrange(1, 5), rng.choice([0, 1]))
    for (text, path, linked), y in zip(page, labels, strict=True):
        if y:
            inner = tuple(x for x in path if x not in ("html", "body", *MAIN_NAMES))
            if rng.random() < 0.06:
                side((*wrap, *main, *rng.choice([("div", "ad"), ("aside",), ("form", "label"), ("div", "share"), ("div", "related", "a"), ("figure", "advert")])), 1, rng.choice([0, 1]))
            out.append((text, (*wrap, *main, *inner), linked))
        else:
            out.append((text, path, linked))
        marks.append(y)
    for path, linked in ((("section", "comments", "div", "comment", "p"), 0), (("ol", "comment", "list", "li", "p"), 0), (("aside", "sidebar", "ul", "li"), 1), (("div", "sidebar", "p"), 0),
                         (("div", "footer"), 0), (("footer", "p"), 0), (("form", "label"), 0), (("div", "newsletter", "form"), 0), (("div", "ads"), 0)):
        if rng.random() < 0.3:
            inside = main if rng.random() < 0.3 else ()
            side((*wrap, *inside, *path), rng.randrange(1, 6), linked)
    return out, np.array(marks, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors, with a logistic output per block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + FIGURES
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"path": draw(PATH_ROWS, PATH_DIM, scale=0.3), "word": draw(WORD_ROWS, WORD_DIM, scale=0.1),
                  "out": draw(2 * HIDDEN + size, 1, scale=0.1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w[f"x{side}"] = draw(size, 4 * HIDDEN, scale=size ** -0.5)
            self.w[f"h{side}"] = draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN ** -0.5)
            self.w[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def vectors(self, page: tuple) -> np.ndarray:
        paths, words, figures = page
        mean = lambda table, rows: np.add.reduceat(table[np.concatenate(rows)], np.cumsum([0, *map(len, rows[:-1])])) / np.array([[len(r)] for r in rows], np.float32)
        return np.concatenate([mean(self.w["path"], paths), mean(self.w["word"], words), figures], 1)

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: time, pages, size.  Forward in the given order of time."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        given = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            z = given[t] + h @ self.w[f"h{side}"]
            g = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            before, h_before = c, h
            c = f * c + i * u
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep is not None:
                keep.append((i, f, o, u, before, s, h_before))
        return out

    @staticmethod
    def _turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each page's own steps in reverse; padding stays behind."""
        t = np.arange(len(x))[:, None]
        return np.take_along_axis(x, np.where(t < n, n - 1 - t, t)[:, :, None], 0)

    def _stacked(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p[2]) for p in pages])
        x = np.zeros((n.max(), len(pages), PATH_DIM + WORD_DIM + FIGURES), np.float32)
        for k, p in enumerate(pages):
            x[:n[k], k] = self.vectors(p)
        return x, n

    def scores(self, pages: list[tuple]) -> list[np.ndarray]:
        x, n = self._stacked(pages)
        both = np.concatenate([self._run(x, "f"), self._turned(self._run(self._turned(x, n), "b"), n), x], 2)
        p = _sigmoid((both @ self.w["out"])[:, :, 0] + self.w["bias"])
        return [p[:n[k], k] for k in range(len(pages))]

    def step(self, pages: list[tuple], labels: list[np.ndarray], rate: float, memory: dict) -> float:
        """One Adam step of the mean log loss; the loss."""
        x, n = self._stacked(pages)
        kept: dict[str, list] = {"f": [], "b": []}
        hf = self._run(x, "f", kept["f"])
        xb = self._turned(x, n)
        hb = self._turned(self._run(xb, "b", kept["b"]), n)
        both = np.concatenate([hf, hb, x], 2)
        p = _sigmoid((both @ self.w["out"])[:, :, 0] + self.w["bias"])
        y, real = np.zeros_like(p), np.arange(len(x))[:, None] < n
        for k, v in enumerate(labels):
            y[:len(v), k] = v
        total = max(1, real.sum())
        d = (np.where(real, p - y, 0) / total).astype(np.float32)
        g = {"out": np.einsum("tps,tp->s", both, d)[:, None], "bias": d.sum(keepdims=True)[0]}
        d_both = d[:, :, None] * self.w["out"][:, 0]
        dx = d_both[:, :, 2 * HIDDEN:].copy()
        for side, given, d_h in (("f", x, d_both[:, :, :HIDDEN]), ("b", xb, self._turned(d_both[:, :, HIDDEN:2 * HIDDEN], n))):
            dz_all = np.empty((*given.shape[:2], 4 * HIDDEN), np.float32)
            dh_next = dc = np.zeros((given.shape[1], HIDDEN), np.float32)
            g[f"h{side}"] = np.zeros_like(self.w[f"h{side}"])
            for t in range(len(given) - 1, -1, -1):
                i, f, o, u, before, s, h_before = kept[side][t]
                dh = d_h[t] + dh_next
                dc = dc + dh * o * (1 - s * s)
                dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], 1)
                g[f"h{side}"] += h_before.T @ dz
                dh_next, dc = dz @ self.w[f"h{side}"].T, dc * f
                dz_all[t] = dz
            g[f"x{side}"] = np.einsum("tps,tpz->sz", given, dz_all)
            g[f"c{side}"] = dz_all.sum((0, 1))
            back = dz_all @ self.w[f"x{side}"].T
            dx += back if side == "f" else self._turned(back, n)
        g["path"], g["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for k, (paths, words, _) in enumerate(pages):
            for name, rows, a, b in (("path", paths, 0, PATH_DIM), ("word", words, PATH_DIM, PATH_DIM + WORD_DIM)):
                size = np.array([len(r) for r in rows])
                np.add.at(g[name], np.concatenate(rows), np.repeat(dx[:n[k], k, a:b] / size[:, None], size, 0))
        memory["t"] = memory.get("t", 0) + 1
        for name, grad in g.items():
            m, v = memory.setdefault(name, [np.zeros_like(self.w[name]), np.zeros_like(self.w[name])])
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            self.w[name] -= rate * (m / (1 - 0.9 ** memory["t"])) / (np.sqrt(v / (1 - 0.999 ** memory["t"])) + 1e-8)
        loss = -np.where(real, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0).sum() / total
        return float(loss)


def trained(pages: Iterable[str], epochs: int = EPOCHS, seed: int = SEED) -> Labeller | None:
    """A labeller trained on pages' semantic labels; None without any block."""
    rng = random.Random(seed)
    cases = []
    for page in pages:
        found = blocks(page)
        if found:
            labels = semantic_labels(found)
            cases += [(found, labels), varied(found, labels, rng), varied(found, labels, rng)]
    if not cases:
        return None
    ready = [(features(b), y) for b, y in cases if len(b)]
    net, memory = Labeller(seed), {}
    for epoch in range(epochs):
        ready.sort(key=lambda c: len(c[1]) + rng.random() * 10)
        groups = [ready[k:k + 12] for k in range(0, len(ready), 12)]
        rng.shuffle(groups)
        for some in groups:
            net.step([c[0] for c in some], [c[1] for c in some], 0.01 * 0.7 ** epoch, memory)
    return net


def sample_pages(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES, most_chars: int = TRAIN_CHARS) -> list[str]:
    """At most ``most`` different pages of at most ``most_chars`` characters, the same ones at every run.  They are
    chosen by their hashes, so that tasks send numbers and not their own ``most`` pages."""
    rows = pages.select(pages[html].cast("string").alias("html")).where((F.length("html") > 0) & (F.length("html") <= most_chars))
    rows = rows.withColumn("h", F.xxhash64("html"))
    chosen = [r.h for r in rows.select("h").distinct().orderBy("h").limit(most).collect()]
    got = rows.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect() if chosen else []
    return [r.html for r in sorted(got, key=lambda r: r.h)]


def groups(sizes: list[int], most: int = 96, cells: int = CELLS) -> Iterable[tuple[int, int]]:
    """(start, end) of runs of ascending ``sizes`` that are padded to their longest: at most
    ``most``, and ``cells`` in all; one that is longer runs alone."""
    start = 0
    for k, size in enumerate(sizes):
        if k > start and (k - start == most or (k - start + 1) * size > cells):
            yield start, k
            start = k
    if sizes:
        yield start, len(sizes)


def _texts(net: Labeller | None, group: int = 96):
    def run(batches):
        for b in batches:
            keys, urls = b.column(0), b.column(1)
            texts = [""] * b.num_rows
            found = {}
            for k, page in enumerate(b.column(2).to_pylist()):
                if page and (got := blocks(page)):
                    found[k] = got
            order = sorted(found, key=lambda k: len(found[k]))
            for at, end in groups([len(found[k]) for k in order], group):
                some = order[at:end]
                if net is None:
                    scores = [semantic_labels(found[k]) for k in some]
                else:
                    scores = net.scores([features(found[k]) for k in some])
                for k, p in zip(some, scores, strict=True):
                    texts[k] = "\n".join(t for (t, _, _), s in zip(found[k], p, strict=True) if s >= 0.5)
            yield pa.RecordBatch.from_arrays([keys, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", net: Labeller | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars.  Without ``net`` one is trained on a sample."""
    net = net or trained(sample_pages(pages, html))
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(_texts(net), "page_id long, url string, text string, n_chars long")
