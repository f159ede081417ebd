"""Minimax sharding and exact dedup against brute force."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import heavy_dedup as H
from ledgerlake.llm import minimax_shards as M

from .conftest import ODD_TEXTS, SF


def brute_capacity(sizes, shards):
    best = None
    n = len(sizes)
    for k in range(min(shards, n)):
        for cut in itertools.combinations(range(1, n), k):
            edges = [0, *cut, n]
            most = max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges))
            best = most if best is None else min(best, most)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 5))
def test_capacity_is_smallest_and_cuts_keep_it(sizes, shards):
    cap = M.smallest_capacity(sizes, shards)
    assert cap == brute_capacity(sizes, shards)
    edges = [0, *M.cuts(sizes, shards), len(sizes)]
    assert len(edges) - 1 <= shards and edges == sorted(set(edges))
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges)) <= cap


def test_no_sizes():
    assert M.smallest_capacity([], 3) == 0 and M.cuts([], 3) == []


@pytest.mark.parametrize("shards", [1, 4])
def test_shards_of_odd_rows(docs_of, clashing, shards):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "same"), (7, "same"), (7, "same"), (900, "")] + [(k, "hot") for k in range(100, 140)]
    got = M.minimax_shards(docs_of(pairs, clashing), shards).toPandas()
    assert len(got) == len(pairs)
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in pairs)
    assert Counter((None if pd.isna(k) else int(k), s, c) for k, s, c in zip(got.doc_id, got["size"], got.text_crc32)) == want
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert M.minimax_shards(docs_of([]), shards).count() == 0


def test_shards_near_equal(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").dropDuplicates(["text"])
    got = M.minimax_shards(docs, 5).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(got) == 5 and got.max() / got.mean() < 1.05


def brute_dedup(pairs):
    groups = defaultdict(list)
    for k, t in pairs:
        groups[t or ""].append(k)
    out = []
    for k, t in pairs:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((k, keep, len(ids), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_dedup_of_odd_rows(docs_of, clashing, counters):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "same"), (7, "same"), (70, "same"), (None, "nokey"), (None, "nokey")]
    pairs += [(k, "hot") for k in range(100, 160)] + [(k, "warm") for k in range(200, 215)] + [(159, "hot")]
    docs = docs_of(pairs, clashing)
    got = H.exact_duplicates(docs, counters=counters)
    assert Counter(map(tuple, got.collect())) == brute_dedup(pairs)
    left = H.deduplicated(docs, counters=counters)
    assert left.columns == docs.columns
    texts = {t or "" for _, t in pairs}
    rows = left.select("doc_id", "text").collect()
    assert Counter(r.text or "" for r in rows) == Counter(texts)
    keep = {h: k for _, k, _, _, h in brute_dedup(pairs)}
    assert all(r.doc_id == keep[hashlib.sha256((r.text or "").encode()).hexdigest()] for r in rows)


def test_dedup_empty(docs_of):
    assert H.exact_duplicates(docs_of([])).count() == 0
    assert H.deduplicated(docs_of([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=30), max_size=6), st.integers(1, 4))
def test_misra_gries_keeps_frequent(batches, room):
    counts = {}
    for b in batches:
        counts = H.misra_gries(counts, dict(Counter(b)), room)
        assert len(counts) <= room
    true = Counter(x for b in batches for x in b)
    total = sum(true.values())
    assert all(v in counts for v, n in true.items() if n > total / (room + 1))
    assert all(n <= true[v] for v, n in counts.items())


def test_shards_need_no_python_on_the_executors(spark, docs_of, monkeypatch):
    """No step, written ones included, maps rows in Python; the slots stay gapless where few partitions hold a shard."""
    docs = docs_of([(k, f"text {k % 70}") for k in range(400)])

    def refused(*_, **__):
        raise AssertionError("a map in Python")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    slots = defaultdict(list)
    for r in M.minimax_shards(docs, 5).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 400
