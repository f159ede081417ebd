"""Gumbel top-k segmentation against a lattice enumerated by brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import gumbel_segments as G
from ledgerlake.llm.tokens import tokenizer_path

from .conftest import ODD_TEXTS, SF


@pytest.fixture(scope="module")
def pieces():
    return G._pieces(tokenizer_path(G.MODEL_FILE), G.ALPHA)


def all_ways(pieces, text):
    """Every segmentation with its log weight."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(G.MODEL_FILE))
    of = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = "▁" + text.replace(" ", "▁")

    def ways(at):
        if at == len(s):
            return [((), 0.0)]
        out = []
        for to in range(at + 1, len(s) + 1):
            if s[at:to] in of:
                i = of[s[at:to]]
                out += [((i, *w), q + pieces.log_prob[i]) for w, q in ways(to)]
        if s[at] not in of:
            own = tuple(pieces.bytes_from + b for b in s[at].encode())
            out += [(own + w, q + len(own) * pieces.log_prob[pieces.bytes_from]) for w, q in ways(at + 1)]
        return out

    found = dict(ways(0))
    z = np.logaddexp.reduce(list(found.values()))
    return {w: q - z for w, q in found.items()}


@pytest.mark.parametrize("text", ["the cat", "  a  b", "ab\n\U0001f9ff", "x", "over the"])
def test_first_draw_follows_the_lattice(pieces, text):
    true = all_ways(pieces, text)
    n = 6000
    got = G.draws(pieces, list(range(n)), pa.array([text] * n), 1)
    seen = Counter(tuple(paths[0][0].tolist()) for paths, _ in got)
    assert set(seen) <= set(true)
    for paths, _ in got[:50]:
        assert paths[0][1] == pytest.approx(true[tuple(paths[0][0].tolist())], abs=1e-9)
    for w, q in sorted(true.items(), key=lambda x: -x[1])[:5]:
        p = math.exp(q)
        assert abs(seen[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3


@pytest.mark.parametrize("text", ["the", "a b", "cat"])
def test_draws_without_replacement(pieces, text):
    true = all_ways(pieces, text)
    n, k = 6000, 3
    got = G.draws(pieces, list(range(n)), pa.array([text] * n), k)
    pairs = Counter()
    weights = Counter()
    for paths, threshold in got:
        drawn = [tuple(ids.tolist()) for ids, _, _ in paths]
        assert len(set(drawn)) == len(drawn) == min(k, len(true))
        tops = [t for _, _, t in paths]
        assert tops == sorted(tops, reverse=True) and tops[-1] > threshold
        pairs[tuple(drawn[:2])] += 1
        for ids, q, _ in paths:
            weights[tuple(ids.tolist())] += math.exp(q - G.log_inclusion(q, threshold))
    # Successive sampling: P(a, b) = p_a p_b / (1 - p_a).
    for (a, b) in itertools.islice(sorted(itertools.permutations(true, 2), key=lambda ab: -true[ab[0]] - true[ab[1]]), 4):
        p = math.exp(true[a] + true[b]) / (1 - math.exp(true[a]))
        assert abs(pairs[a, b] / n - p) < 5 * math.sqrt(p / n) + 2e-3
    # Inclusion scores make the sample's weights unbiased: they sum to each probability.
    for w, q in sorted(true.items(), key=lambda x: -x[1])[:3]:
        assert weights[w] / n == pytest.approx(math.exp(q), rel=0.12, abs=4e-3)


def test_all_segmentations_when_few(pieces):
    true = all_ways(pieces, "of")
    paths, threshold = G.draws(pieces, [3], pa.array(["of"]), 50)[0]
    assert {tuple(i.tolist()) for i, _, _ in paths} == set(true)
    assert threshold == -math.inf and G.log_inclusion(paths[0][1], threshold) == 0


def test_words(pieces):
    for text in ["a b", " a", "a  b ", "▁a ▁", "x\ty\n z", "   "]:
        assert "".join("▁" + w for w in G.words_of(text)) == "▁" + text.replace(" ", "▁")
    assert G.words_of(None) == G.words_of("") == []
    texts = ["a b", None, "", " a", "a  b ", "▁a ▁", "x\ty\n z", "   ", "b a", "é \U0001f600"]
    distinct, of = G.numbered(pa.array(texts))
    assert [[distinct[k] for k in ids] for ids in of] == [G.words_of(t) or ([""] if t == "" and len(ids) else []) for t, ids in zip(texts, of, strict=True)]
    assert len(of[1]) == len(of[2]) == 0


def test_decoding_matches_the_library(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(G.MODEL_FILE))
    for text in ["Hello  world\n xé\U0001f600 y", "ünï\tcödé", "a"]:
        assert pieces.decode(sp.encode(text)) == text
        for ids, _, _ in G.draws(pieces, [1], pa.array([text]), 4)[0][0]:
            assert pieces.decode(ids.tolist()) == text == sp.decode(ids.tolist())


def test_rows(spark, docs_of, clashing, pieces):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "no key"), (4, "twice"), (4, "twice")]
    out = G.segmentations(docs_of(pairs, clashing), with_ids=True).collect()
    texts = Counter((k, t or "") for k, t in pairs)
    best = Counter((r.doc_id, pieces.decode(r.ids)) for r in out if r["sample"] == 0)
    assert best == Counter({(k, t): n for (k, t), n in texts.items()})
    assert all(r.log_prob <= r.log_inclusion + 9 and r.log_inclusion <= 0 for r in out)
    twice = [r for r in out if r.doc_id == 4 and pieces.decode(r.ids) == "twice"]
    assert len(twice) == 6 and len({tuple(r.ids) for r in twice}) == 3
    assert G.segmentations(docs_of([])).count() == 0
    # A row's draws depend on neither its batch nor its partition.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {tuple(r) for r in G.segmentations(docs.repartition(7)).collect()}
    assert a == {tuple(r) for r in G.segmentations(docs.orderBy("text").coalesce(1)).collect()}


@pytest.mark.parametrize("most_edges", [4_000_000, 0])
def test_lattices_are_kept_from_batch_to_batch(pieces, monkeypatch, most_edges):
    """A later batch builds the lattices of new words only, until there are too many; draws are those of a batch of its own."""
    monkeypatch.setattr(G, "MOST_EDGES", most_edges)
    built = []
    real = G.Lattices
    monkeypatch.setattr(G, "Lattices", lambda p, words: built.append(len(words)) or real(p, words))
    batches = [["the cat sat", "  a  b", None], ["the cat ran", "  a  b", "▁a é"], ["sat the cat"], ["", None]]
    words = G.Words()
    keys = [5, 6, 7]
    got = [G.draws(pieces, keys[:len(b)], pa.array(b, pa.string()), 3, words=words) for b in batches]
    total = sum(built)
    alone = [G.draws(pieces, keys[:len(b)], pa.array(b, pa.string()), 3) for b in batches]
    assert total < sum(built) - total if most_edges else total == sum(built) - total
    plain = lambda found: [([(ids.tolist(), q, top) for ids, q, top in paths], t) for paths, t in found]
    assert [plain(g) for g in got] == [plain(a) for a in alone]


def test_branches_of_many_texts_together(pieces):
    """Texts of any length side by side, beyond the steps and texts looked at together, draw as alone."""
    texts = ["x", "", "the cat " * 300, "of", None, *[f"word {k} " * (k % 40) for k in range(2 * G.TEXTS)]]
    keys = list(range(len(texts)))
    together = G.draws(pieces, keys, pa.array(texts), 4)
    for k in [0, 1, 2, 3, 4, 44, 45, 46, G.TEXTS, len(texts) - 1]:
        (paths, threshold), = G.draws(pieces, [k], pa.array([texts[k]], pa.string()), 4)
        assert [(i.tolist(), q, t) for i, q, t in paths] == [(i.tolist(), q, t) for i, q, t in together[k][0]] and threshold == together[k][1]
