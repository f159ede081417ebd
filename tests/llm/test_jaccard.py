"""Prefix-tree join against all pairs compared by brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import prefix_tree_join as J
from ledgerlake.llm.components import components

from .conftest import ODD_TEXTS, SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def forest(n, links):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
    return [root(k) for k in range(n)]


def brute(pairs, n, percent):
    sets = [grams(t, n) for _, t in pairs]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = forest(len(sets), links)
    out = []
    for (k, _), s, c in zip(pairs, sets, of, strict=True):
        ids = [p[0] for p, o in zip(pairs, of, strict=True) if o == c and p[0] is not None]
        out.append((k, len(s), (min(ids, default=None) if s else k)))
    return sorted(out, key=str)


def joined(docs, n, percent, **limits):
    return sorted((tuple(r)[:3] for r in J.jaccard_components(docs, n, percent, **limits).collect()), key=str)


def near_copies(seed=1, groups=14, most=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=25))
    pairs = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(3, words))
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                kind, at = rng.random(), rng.randrange(len(own))
                if kind < 0.5:
                    own[at] = rng.choice(vocabulary)
                elif kind < 0.75:
                    own.insert(at, rng.choice(vocabulary))
                elif len(own) > 1:
                    del own[at]
            text = " ".join(own)
            if rng.random() < 0.3:
                text = text.upper() + "\n"
            if rng.random() < 0.3:
                text += " " + shared
            pairs.append((len(pairs) * 3 % 401 + len(pairs), text))
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("limits", [{}, {"block_sets": 4, "heavy_grams": 20, "most_broadcast": 0}, {"block_grams": 200, "heavy_grams": 0}])
def test_components_of_near_copies(docs_of, clashing, limits):
    pairs = near_copies() + [(5000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "one two three four five"), (6000, "One two THREE four  five"),
                                                                              (6001, "Ünï cödé"), (6002, "ünï cödé"), (7, "rep eat"), (7, "rep eat")]
    assert joined(docs_of(pairs, clashing), 4, 85, **limits) == brute(pairs, 4, 85)


@pytest.mark.parametrize("n,percent", [(5, 80), (1, 60), (2, 100)])
def test_other_limits(docs_of, n, percent):
    pairs = near_copies(seed=2, groups=8)
    assert joined(docs_of(pairs), n, percent, block_sets=6) == brute(pairs, n, percent)


def test_one_group_of_many_near_copies(docs_of):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(40)]
    pairs = []
    for k in range(120):
        own = list(base)
        own[rng.randrange(40)] = f"x{rng.randrange(9)}"
        pairs.append((k, " ".join(own)))
    assert joined(docs_of(pairs), 4, 85, block_sets=10, heavy_grams=8) == brute(pairs, 4, 85)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert joined(docs, 4, 85) == brute(pairs, 4, 85)
    assert joined(docs, 5, 80) == brute(pairs, 5, 80)


def test_empty(docs_of):
    assert joined(docs_of([]), 4, 85) == []
    assert joined(docs_of([(3, None), (4, "")]), 4, 85) == [(3, 0, 3), (4, 0, 4)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.sampled_from([50, 80, 85, 100]))
def test_trie_links(sets, percent):
    sets = sorted(sets, key=len)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    found = J.linked(arrays, percent)
    for a, b in found:
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    same = lambda of: [[x == y for y in of] for x in of]
    assert same(forest(len(sets), found)) == same(forest(len(sets), links))


@settings(max_examples=12, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_connected_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = forest(31, edges)
    for k in {k for e in edges for k in e if e[0] != e[1]}:
        assert got[k] == min(j for j in range(31) if of[j] == of[k])


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 90), st.integers(0, 40), st.integers(0, 40), st.sampled_from([30, 50, 60, 80, 85, 99, 100]), st.randoms(use_true_random=False))
def test_linked_sets_share_enough_of_their_prefixes(common, a, b, percent, rng):
    """The least overlaps that still link are the hard cases."""
    while 100 * common < percent * (common + a + b):
        a, b = (a - 1, b) if a >= b else (a, b - 1)
    keys = rng.sample(range(1000), common + a + b)
    x, y = sorted(keys[:common + a]), sorted(keys[:common] + keys[common + a:])
    px, py = (set(s[:J.prefix_taken(len(s), percent)]) for s in (x, y))
    assert len(px & py) >= max(J.shared_least(len(x), percent), J.shared_least(len(y), percent))
    assert set(x[:J.prefix_length(len(x), percent)]) & set(y[:J.prefix_length(len(y), percent)])


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 30), st.integers(0, 30), st.sampled_from([30, 50, 80, 85, 100]), st.randoms(use_true_random=False))
def test_linked_sets_are_partners_by_their_prefixes(common, a, b, percent, rng):
    while 100 * common < percent * (common + a + b):
        a, b = (a - 1, b) if a >= b else (a, b - 1)
    keys = rng.sample(range(1000), common + a + b)
    x, y = sorted([keys[:common + a], keys[:common] + keys[common + a:]], key=len)
    sizes = np.array([len(x), len(y)])
    prefixes = [np.array(sorted(s)[:J.prefix_taken(len(s), percent)], np.uint64) for s in (x, y)]
    first = int(np.intersect1d(*prefixes)[0])
    assert J.paired(prefixes, sizes, percent, first).all() and not J.paired(prefixes, sizes, percent, first + 1).any()
    assert J.rest_most(sizes, percent).tolist() == [n - J.prefix_taken(n, percent) for n in sizes.tolist()]


def test_shingle_sets():
    texts = [None, "", "a b c", "A b  C\td\x0be", "x", "É é", "a b c d e f", " a b c d e f "]
    import pyarrow as pa

    got = J.shingle_sets(pa.array(texts, pa.string()).cast(pa.binary()), 4)
    assert [len(g) for g in got] == [len(grams(t, 4)) for t in texts]
    assert (got[6] == got[7]).all() and set(got[3].tolist()) & set(got[6].tolist())
    for other in (texts[::-1], texts[2:]):
        again = J.shingle_sets(pa.array(other, pa.string()).cast(pa.binary()), 4)
        assert all((dict(zip(map(repr, texts), map(list, got)))[repr(t)] == list(g)) for t, g in zip(other, again))


@pytest.mark.parametrize("n", [4, 5])
def test_shingle_sets_of_one_short_text(n):
    import pyarrow as pa

    for words in range(7):
        got = J.shingle_sets(pa.array([" ".join("abcdef"[:words])], pa.string()).cast(pa.binary()), n)
        assert [len(g) for g in got] == [max(min(words, 1), words - n + 1)]
