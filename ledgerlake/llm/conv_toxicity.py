"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its
beginnings (so that unseen compounds share what their stem has learnt).  Filters
of widths 1, 2 and 3 run over the words of the whole text; the largest response
of each, at least zero, goes into a logistic output.

Training: every labelled row outside fold 0 takes part, with its whole text.  The rows are dealt
by hash to chunks of some ``CHUNK_ROWS`` rows.  A single chunk is fitted in ``EPOCHS`` epochs; of several
the first one gives the weights a start, then each of ``PASSES`` passes fits all chunks at once, each from
the same weights, and the changes are averaged (an embedding over the chunks that changed it), block by
block in Spark.  A text's chunk and a chunk's order depend on keys and texts alone, and so do the weights.
Fold 1 is set aside to calibrate the thresholds, which a skew-safe running count over all its
scores finds.  Each language has its own: the language is guessed from the text's function words,
and the score is shifted so that 0.5 is the language's threshold.  Keys, language
tags and sources never enter a score.  Scoring is a map over all rows without a
shuffle; the weights (about 1.6 MB) go to the tasks and come back averaged.

Defined cases: null or empty texts get the score of a text without words;
long texts are learnt and scored whole; repeated rows get equal
scores and train once; null keys never train; without both labels all scores are
the share of toxic labels; extra columns play no part.
"""

from __future__ import annotations

import copy
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import grouped_prefix_sums
from ..session import shuffle_partitions
from .common import broadcast_if_small, key_and_text, lean, rewritten

#: Bounds of the sample that ``training_rows`` gives, for nets made apart from the query.
TOXIC_ROWS, OTHER_ROWS, TRAIN_CHARS = 3000, 5000, 20_000
#: Rows and bytes of text in a chunk, which one task learns from; passes over all chunks.
CHUNK_ROWS, CHUNK_BYTES, PASSES = 4000, 32 << 20, 2
#: Embedding rows whose changes are averaged together.
BLOCK = 1024
ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 5, 16, 0.01, 7
STEMS = (3, 4, 5, 6, 7)
TAPS = sum(WIDTHS)
PIECE = 50_000
MEMO_WORDS = 250_000
#: Toxic rows with which a language gets a threshold of its own.
LANGUAGE_TOXIC = 20
LANGUAGES = ("en", "de", "fr", "es")
#: Function words that give a language away (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with as be this from are by".split(),
    "de": "der die und das nicht von sie ist des sich mit dem ein eine auf den zu".split(),
    "fr": "le les et des que qui dans une pour pas sur est du au avec".split(),
    "es": "el los las del que y con para por no una su al lo es".split(),
}
_TRIM = "\"'.,;:!?()[]{}<>*#$%&|-_/"
#: Languages of a function word as bits, and which languages a number of bits stands for.
_LANGUAGE_OF = {w: sum((w in FUNCTION_WORDS[k]) << i for i, k in enumerate(LANGUAGES)) for words in FUNCTION_WORDS.values() for w in words}
_BITS = np.array([[code >> i & 1 for i in range(len(LANGUAGES))] for code in range(1 << len(LANGUAGES))], np.int64)
#: Checksums that a word's own and its beginnings' go on from.
_OWN, _FROM = zlib.crc32(b"="), [(n, zlib.crc32(str(n).encode())) for n in STEMS]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_rows(word: str) -> list[int]:
    """Embedding rows of a word as written: itself and its beginnings, without punctuation."""
    w = word.strip(_TRIM)
    b, long = w.encode(), len(w)
    if len(b) == long:
        return [zlib.crc32(b, _OWN) % ROWS, *[zlib.crc32(b[:n], c) % ROWS for n, c in _FROM if long >= n]]
    return [zlib.crc32(b, _OWN) % ROWS, *[zlib.crc32(w[:n].encode(), c) % ROWS for n, c in _FROM if long >= n]]


class ConvNet:
    """Weights and their training."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {"rows": (rng.standard_normal((ROWS, DIM)) * 0.1).astype(np.float32),
                  "taps": (rng.standard_normal((DIM, TAPS * FILTERS)) * 0.4).astype(np.float32),
                  "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32),
                  "out": (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.4).astype(np.float32), "base": np.zeros(1, np.float32)}
        self.thresholds = np.zeros(len(LANGUAGES) + 1)
        self.share: float | None = None

    def vectors(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, DIM), np.float32)
        return np.add.reduceat(self.w["rows"][np.fromiter(chain.from_iterable(rows), np.int64)], np.cumsum([0, *map(len, rows[:-1])]))

    @staticmethod
    def responses(g: np.ndarray):
        """Per width: the filters' responses at each position of projected words ``g``."""
        at = 0
        for w in WIDTHS:
            n = len(g) - w + 1
            if n > 0:
                yield w, at, sum(g[t:t + n, (at + t) * FILTERS:(at + t + 1) * FILTERS] for t in range(w))
            at += w

    def pooled(self, g: np.ndarray) -> np.ndarray:
        """Largest response of each filter over a whole text, at least zero."""
        top = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for a in range(0, max(1, len(g)), PIECE):
            for w, _, z in self.responses(g[a:a + PIECE + max(WIDTHS) - 1]):
                k = WIDTHS.index(w) * FILTERS
                np.maximum(top[k:k + FILTERS], z.max(0), out=top[k:k + FILTERS])
        return np.maximum(top + self.w["bias"], 0)

    def logit(self, g: np.ndarray) -> float:
        return float(self.pooled(g) @ self.w["out"] + self.w["base"][0])

    def fit(self, texts: list[list[int]], labels: np.ndarray, vocabulary: list[list[int]], epochs: int = EPOCHS, seed: int = SEED, most: float = RATE) -> None:
        """``texts`` hold word numbers into ``vocabulary`` (embedding rows of each word); ``most`` is the first epoch's rate."""
        rng = np.random.default_rng(seed)
        memory: dict = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                used, inverse = np.unique(np.concatenate([np.asarray(texts[k], np.int64) for k in some]), return_inverse=True)
                rows = [vocabulary[k] for k in used.tolist()]
                v = self.vectors(rows)
                g_words = v @ self.w["taps"]
                grad = {k: np.zeros_like(x) for k, x in self.w.items() if k != "rows"}
                dv = np.zeros_like(v)
                begin = 0
                for k in some:
                    ids = inverse[begin:begin + len(texts[k])]
                    begin += len(ids)
                    top, where = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), {}
                    for w, tap, z in self.responses(g_words[ids]):
                        a = WIDTHS.index(w) * FILTERS
                        best = z.argmax(0)
                        top[a:a + FILTERS] = z[best, np.arange(FILTERS)]
                        where[w] = (tap, a, best)
                    h = np.maximum(top + self.w["bias"], 0)
                    h = np.where(np.isfinite(h), h, 0)
                    p = 1 / (1 + np.exp(-np.clip(h @ self.w["out"] + self.w["base"][0], -30, 30)))
                    d = (p - labels[k]) / len(some)
                    grad["out"] += d * h
                    grad["base"] += d
                    dh = d * self.w["out"] * (h > 0)
                    grad["bias"] += dh
                    for w, (tap, a, best) in where.items():
                        for step in range(w):
                            word = ids[best + step]
                            cols = (tap + step) * FILTERS + np.arange(FILTERS)
                            grad["taps"][:, cols] += v[word].T * dh[a:a + FILTERS]
                            np.add.at(dv, word, dh[a:a + FILTERS, None] * self.w["taps"][:, cols].T)
                t += 1
                rate = most * 0.75 ** epoch * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
                for name, x in grad.items():
                    self._adam(memory[name], name, slice(None), x, rate)
                hit = np.flatnonzero(np.abs(dv).sum(1))
                if len(hit):
                    flat = np.concatenate([np.asarray(rows[k]) for k in hit])
                    each = np.repeat(dv[hit], [len(rows[k]) for k in hit], 0)
                    here, back = np.unique(flat, return_inverse=True)
                    total = np.zeros((len(here), DIM), np.float32)
                    np.add.at(total, back, each)
                    self._adam(memory["rows"], "rows", here, total, rate)

    def _adam(self, memory: list, name: str, where, grad: np.ndarray, rate: float) -> None:
        m, v = memory
        m[where] += 0.1 * (grad - m[where])
        v[where] += 0.001 * (grad * grad - v[where])
        self.w[name][where] -= (rate * m[where] / (np.sqrt(v[where]) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores texts; words are projected once per worker while they stay in the memo."""

    def __init__(self, net: ConvNet):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, TAPS * FILTERS), np.float32)
        self.speaks = np.zeros(0, np.uint8)

    def _project(self, new: list[str]) -> None:
        """Words' projections and languages, at the end of tables that double when they are full."""
        at, end = len(self.number), len(self.number) + len(new)
        if end > len(self.table):
            table, speaks = self.table, self.speaks
            room = max(end, 2 * len(table), 1 << 14)
            self.table, self.speaks = np.empty((room, TAPS * FILTERS), np.float32), np.empty(room, np.uint8)
            self.table[:at], self.speaks[:at] = table[:at], speaks[:at]
        self.table[at:end] = self.net.vectors([word_rows(w) for w in new]) @ self.net.w["taps"]
        self.speaks[at:end] = [_LANGUAGE_OF.get(w.strip(_TRIM), 0) for w in new]
        self.number.update(zip(new, range(at, end), strict=True))

    def parts(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """(logit, language number) of each text; the last number stands for no known language."""
        if len(self.number) > MEMO_WORDS:
            self._clear()
        cut = [words_of(t) for t in texts]
        new = list({w for words in cut for w in words if w not in self.number})
        if new:
            self._project(new)
        out = []
        for words in cut:
            ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            votes = np.bincount(self.speaks[ids], minlength=len(_BITS)) @ _BITS
            out.append((self.net.logit(self.table[ids]) if len(ids) <= PIECE else self._long(ids), int(votes.argmax()) if votes.any() else len(LANGUAGES)))
        return out

    def _long(self, ids: np.ndarray) -> float:
        step, more = PIECE, max(WIDTHS) - 1
        top = np.max([self.net.pooled(self.table[ids[a:a + step + more]]) for a in range(0, len(ids), step)], 0)
        return float(top @ self.net.w["out"] + self.net.w["base"][0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net.share is not None:
            return np.full(len(texts), self.net.share)
        parts = self.parts(texts)
        logits = np.array([x for x, _ in parts]) - self.net.thresholds[[k for _, k in parts]]
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, midway between the neighbouring logits."""
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2) if k + 1 < len(x) else float(x[k] - 1)


def trained(rows: list[tuple[str | None, int, bool]]) -> ConvNet:
    """From (text, label, whether set aside for calibration)."""
    net = ConvNet()
    labels = np.array([y for _, y, _ in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        net.share = float(labels.mean()) if len(rows) else 0.0
        return net
    cut, vocabulary = _numbered([t for t, _, _ in rows])
    fit = [k for k, (_, _, aside) in enumerate(rows) if not aside and len(cut[k])]
    if fit:
        net.fit([cut[k] for k in fit], labels[fit], vocabulary)
    aside = [k for k, r in enumerate(rows) if r[2]] or list(range(len(rows)))
    parts = Scorer(net).parts([rows[k][0] for k in aside])
    logits, spoken, y = np.array([x for x, _ in parts]), np.array([k for _, k in parts]), labels[aside]
    net.thresholds[:] = best_threshold(logits, y) if y.any() else float(logits.max()) + 1
    for k in range(len(LANGUAGES)):
        own = spoken == k
        if y[own].sum() >= LANGUAGE_TOXIC:
            net.thresholds[k] = best_threshold(logits[own], y[own])
    return net


def _numbered(texts: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
    """Texts as word numbers, and each word's embedding rows."""
    numbers: dict[str, int] = {}
    cut = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int64) for t in texts]
    return cut, [word_rows(w) for w in numbers]


def fold(key: Column) -> Column:
    """crc32 of the key's text, modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def _marks(labels: DataFrame) -> DataFrame:
    """Labels outside fold 0, one a key."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
            .where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> list[tuple[str | None, int, bool]]:
    """A bounded sample of labelled rows outside fold 0; fold 1 is set aside."""
    marks = _marks(labels)
    first = lambda y, n: marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, toxic_rows).unionByName(first(0, other_rows))  # at most 8,000 ids
    rows = key_and_text(docs).where(F.octet_length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id")
    # One text for an id, whatever often its key is repeated.
    got = (rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
           .select("doc_id", "text", "toxic", (fold(F.col("doc_id")) == 1).alias("aside")).collect())
    return [(r.text, r.toxic, r.aside) for r in sorted(got, key=lambda r: (r.doc_id, r.text))]


def learned(docs: DataFrame, labels: DataFrame) -> ConvNet:
    """A net from every labelled row outside fold 0 (see the module's text)."""
    spark = docs.sparkSession
    marks = broadcast_if_small(rewritten(_marks(labels), "toxic-marks"))
    rows = rewritten(key_and_text(docs).join(marks, "doc_id").dropDuplicates(["doc_id", "text"])
                     .select("*", (fold(F.col("doc_id")) == 1).alias("aside")), "toxic-rows")
    one, fits = F.when(~F.col("aside"), 1), F.when(~F.col("aside"), F.octet_length("text"))
    n, share, least, most, to_fit, size = rows.agg(F.count(F.lit(1)), F.avg("toxic"), F.min("toxic"), F.max("toxic"), F.count(one), F.sum(fits)).first()
    net = ConvNet()
    if not n or least == most:
        net.share = float(share) if n else 0.0
        return net
    chunks = max(1, -(-to_fit // CHUNK_ROWS), -(-(size or 0) // CHUNK_BYTES))
    dealt = rows.where("NOT aside").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    if to_fit:
        with shuffle_partitions(spark, int(min(chunks, 10_000))):
            _pass(net, dealt.where("chunk = 0"), EPOCHS, RATE)
            for k in range(PASSES if chunks > 1 else 0):
                _pass(net, dealt, 1, RATE * 0.5 ** (k + 1))
    _calibrate(net, rows.where("aside") if to_fit < n else rows)
    return net


def _pass(net: ConvNet, dealt: DataFrame, epochs: int, rate: float) -> None:
    """Fit each chunk from the net's weights and add the averaged changes to them."""
    dense = [k for k in net.w if k != "rows"]

    def fitted(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        cut, vocabulary = _numbered(t.column("text").to_pylist())
        some = [k for k, words in enumerate(cut) if len(words)]
        own = copy.deepcopy(net)
        own.fit([cut[k] for k in some], t.column("toxic").to_numpy().astype(np.float32)[some], vocabulary, epochs, most=rate)
        more = own.w["rows"] - net.w["rows"]
        parts = [(k // BLOCK, more[k:k + BLOCK]) for k in range(0, ROWS, BLOCK)]
        parts.append((-1, np.concatenate([(own.w[k] - net.w[k]).ravel() for k in dense])))
        parts = [(b, x) for b, x in parts if x.any()]
        return pa.table({"block": pa.array([b for b, _ in parts], pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()] * len(parts), pa.int32()),
                         "more": pa.array([x.astype(np.float32).tobytes() for _, x in parts], pa.binary())})

    def averaged(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        block = t.column("block")[0].as_py()
        total = touched = 0
        for raw in t.column("more"):
            x = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, 1 if block < 0 else DIM)
            total, touched = total + x.astype(np.float64), touched + (x.any(1, keepdims=True) | (block < 0))
        return pa.table({"block": pa.array([block], pa.int32()), "more": pa.array([(total / np.maximum(touched, 1)).astype(np.float32).tobytes()], pa.binary())})

    changes = (dealt.select("chunk", "doc_id", "text", "toxic").groupBy("chunk").applyInArrow(fitted, "block int, chunk int, more binary")
               .groupBy("block").applyInArrow(averaged, "block int, more binary").collect())  # 33 rows
    for block, raw in changes:
        x = np.frombuffer(raw, np.float32)
        if block >= 0:
            net.w["rows"][block * BLOCK:(block + 1) * BLOCK] += x.reshape(-1, DIM)
            continue
        at = 0
        for k in dense:
            net.w[k] += x[at:at + net.w[k].size].reshape(net.w[k].shape)
            at += net.w[k].size


def _calibrate(net: ConvNet, rows: DataFrame) -> None:
    """Thresholds as ``best_threshold`` finds them, over all ``rows``: of all (group -1) and of each language."""

    def scored(batches):
        scorer = Scorer(net)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                c = b.slice(k, 512)
                parts = scorer.parts(c.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([g for _, g in parts], pa.int32()), pa.array([-x for x, _ in parts], pa.float64()), *(c.column(n) for n in ("doc_id", "tie", "toxic"))],
                                                 ["spoken", "low", "doc_id", "tie", "toxic"])

    schema = "spoken int, low double, doc_id long, tie long, toxic long"
    logits = rewritten(rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.col("toxic").cast("long").alias("toxic")).mapInArrow(lean(scored), schema), "toxic-logits")
    logits = logits.select(F.explode(F.array(F.lit(-1), "spoken")).alias("g"), "low", "doc_id", "tie", "toxic", F.lit(1).cast("long").alias("one"))
    sizes = {r.g: r for r in logits.groupBy("g").agg(F.sum("toxic").alias("toxic"), F.min("low").alias("first")).collect()}
    if not sizes[-1].toxic:
        net.thresholds[:] = 1 - sizes[-1].first
        return
    own = {g: r.toxic for g, r in sizes.items() if g == -1 or g < len(LANGUAGES) and r.toxic >= LANGUAGE_TOXIC}
    toxic = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    placed = grouped_prefix_sums(logits.where(F.col("g").isin(*own)), ["g"], ["low", "doc_id", "tie"], ["toxic", "one"])
    f1 = 2 * (F.col("toxic_before") + F.col("toxic")) / (F.col("one_before") + 1 + toxic[F.col("g")])
    best = {r.g: r.b for r in placed.groupBy("g").agg(F.max_by(F.struct("one_before", "low"), F.struct(f1, -F.col("one_before"))).alias("b")).collect()}
    after = F.lit(False)
    for g, b in best.items():
        after = after | (F.col("g") == g) & (F.col("one_before") == b.one_before + 1)
    beyond = {r.g: r.low for r in placed.where(after).select("g", "low").collect()}
    found = {g: -(b.low + beyond[g]) / 2 if g in beyond else -b.low - 1 for g, b in best.items()}
    net.thresholds[:] = found[-1]
    for g in found:
        if g >= 0:
            net.thresholds[g] = found[g]


def _scored(net: ConvNet):
    kept: list[Scorer] = []

    def run(batches):
        if not kept:
            kept.append(Scorer(net))
        for b in batches:
            p = np.concatenate([np.zeros(0), *(kept[0].scores(b.column(1).slice(k, 512).to_pylist()) for k in range(0, b.num_rows, 512))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, net: ConvNet | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    net = net or learned(docs, labels)
    return key_and_text(docs).mapInArrow(_scored(net), "doc_id long, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
