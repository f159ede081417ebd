"""Encoder, wavelet files and packing: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import hashed_words as H
from ledgerlake.llm import ss_packing as P
from ledgerlake.llm import wavelet_ids as W
from ledgerlake.llm.tokens import SPACES, UnitEncoder, tokenizer_path

from .conftest import ODD_TEXTS, SF


#: The tokenizer as its file has it, set up by nobody.
PLAIN = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_equal_whole_texts(spark):
    rng = random.Random(3)
    marks = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ​　﻿") + ["a", "Bc", "'s", "'", "é", "12", ".", "!!", "😀", "<|endoftext|>", "word.", "Word", "word,", "über!!", "x$$$", "²)", "a1."]
    texts = ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(3000)] + [t or "" for t in ODD_TEXTS]
    texts += ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|> <|endof", "text|> split", " <|endoftext|>", "x <|endof"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    e = UnitEncoder(tokenizer_path(), 4)
    true = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for _ in range(2):  # the second time from the table
        for size in (len(texts), 700):
            for k in range(0, len(texts), size):
                ids, counts = e.batch(pa.array(texts[k:k + size]))
                ends = np.cumsum(counts)
                assert [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)] == true[k:k + size]
    ids, counts = e.batch(pa.array([None, "a b", None, ""]).slice(1))
    assert counts.tolist() == [2, 0, 0] and ids.tobytes() == e.whole(["a b"])[0]
    assert " " in SPACES


@pytest.mark.parametrize("n,size", [(0, 1), (1, 1), (7, 1), (5000, 40), (200000, 300), (70000, 50257)])
def test_wavelet_file(n, size):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, size, n).astype("<u4")
    f = W.WaveletFile(W.build(ids, [5, None], np.array([n // 2, n - n // 2])))
    assert (f.decode() == ids).all() and f.keys == [5, None] and f.lengths.tolist() == [n // 2, n - n // 2]
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert f.access(i) == ids[i]
        assert f.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        assert f.count(int(ids[i])) == (ids == ids[i]).sum()
        k = f.rank(int(ids[i]), i)
        assert f.select(int(ids[i]), k) == i
    if n and size <= 300:
        assert f.occurrences(int(ids[0]))[:50] == np.flatnonzero(ids == ids[0])[:50].tolist() if n < 10000 else True
    assert f.count(10**6) == 0
    with pytest.raises(IndexError):
        f.access(n)
    with pytest.raises(IndexError):
        f.select(10**6, 0)


@pytest.mark.parametrize("shard_bytes", [1 << 30, 60_000])
def test_wavelet_documents(spark, docs_of, clashing, tmp_path, shard_bytes):
    pairs = [(k * 3, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "no key")]
    folder = f"file://{tmp_path}/wm{shard_bytes}"
    index = W.write_ids(docs_of(pairs, clashing), folder, shard_bytes=shard_bytes)
    got = sorted(map(tuple, W.read_documents(spark, folder, index).collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = ids_of(t)
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert W.wavelet_ids(docs_of([])).count() == 0


def packing_holds(rows, pairs, window):
    seqs, docs = {}, {}
    for doc, start, length, c, total, seq, offset in rows:
        assert length > 0
        seqs.setdefault(seq, []).append((offset, length))
        docs.setdefault(doc, []).append((start, length, c, total))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    for k, t in pairs:
        ids, at = ids_of(t), 0
        for start, length, c, total in sorted(docs.pop(k)):
            assert start == at and total == len(ids) and c == crc(ids[start:start + length])
            at += length
        assert at == len(ids)
    assert not docs


@pytest.mark.parametrize("window", [8, 1024])
def test_packing(spark, docs_of, clashing, window, monkeypatch):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "no key")]
    packing_holds(map(tuple, P.packed(docs_of(pairs, clashing), window=window).collect()), pairs, window)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    packing_holds(map(tuple, P.packed(docs, window=window).collect()), pairs, window)
    assert P.packed(docs_of([])).count() == 0


def test_level_choice_minimises_sum_of_squares():
    rng = random.Random(5)
    levels = P.LevelArray(16)
    for _ in range(500):
        size = rng.randrange(1, 16)
        best = {}
        for h in [0, *np.flatnonzero(levels.count).tolist()]:
            if h + size <= 16:
                n = levels.count.copy()
                n[h] -= h > 0
                if h + size < 16:
                    n[h + size] += 1
                best[h] = int((n * n).sum())
        h = levels.best(size)
        assert best[h] == min(best.values())
        levels.place(size, (0, 0, b"x" * size, size))
    assert levels.open == levels.count.sum() == sum(map(len, levels.held))


def test_refill_when_many_open():
    pieces = [(k, 0, bytes(4 * (k % 7 + 1)), 9) for k in range(50)]
    full, rest = P.refill(pieces, 16, 4)
    assert all(sum(len(p[2]) for p in w) == 64 for w in full) and sum(len(p[2]) for p in rest) < 64
    tail = P.power_windows(rest, 16, 4)
    assert sum(len(p[2]) for w in tail for p in w) == sum(len(p[2]) for p in rest)


def test_hash_table():
    rng = np.random.default_rng(1)
    t, have = H.Table(4), {}
    for _ in range(30):
        h = rng.integers(0, 1 << 64, 200, dtype=np.uint64) & np.uint64(0xFFFF00000000000F)
        want = [have.get(k, -1) for k in h.tolist()]
        assert t.find(h).tolist() == want
        new = np.unique(h[np.array(want) < 0])
        have.update(zip(new.tolist(), t.add(new).tolist(), strict=True))
    assert len(have) == t.size and t.find(np.array(list(have), np.uint64)).tolist() == list(have.values())


def test_hashed_words_agree_across_chunks():
    words = ["a", "", "abc", "é", "abc", "x" * 70, "", "ab"]
    of = {}
    for texts in (words, [" ".join(words), "abc"], ["pre fix", *words]):
        column = pa.array(texts)
        for _, _, data, offsets in H.chunks(column, 64):
            starts, ends, counts = H.cut(data, offsets, np.flatnonzero(data == 0x20))
            assert counts.sum() == len(starts)
            for h, s, e in zip(H.hashes(data, starts, ends).tolist(), starts, ends, strict=True):
                w = data[s:e].tobytes()
                assert of.setdefault(h, w) == w
    assert len(set(of.values())) == len(of)
