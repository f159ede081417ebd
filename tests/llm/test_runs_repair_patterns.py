"""Periodic runs, conversation repair and benchmark search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import periodic_runs as P
from ledgerlake.llm import queries as Q
from ledgerlake.llm import target_alignment as T
from ledgerlake.llm import word_buffers
from ledgerlake.llm import wu_manber as W

from .conftest import ODD_TEXTS, SF


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- word buffers -------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 0x1F for x in b)), max_size=6))
def test_joined_words(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    words = word_buffers.joined(data, offsets, data != 0x20)
    want = [[w for w in t.split(b" ") if w] for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    assert [words.row(a, b) for a, b in zip(words.first[:-1], words.first[1:])] == [b" ".join(w) for w in want]
    assert words.data.tobytes() == b"".join(b"".join(b" " + x for x in w) + b" \0" for w in want)
    flat = [x for w in want for x in w]
    assert words.chosen(np.arange(0, len(flat), 2)) == b" ".join(flat[::2])


# --- op11 ---------------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                j = i
                while j + q < len(w) and w[j] == w[j + q]:
                    j += 1
                n = j - i + q
                s = w[i:i + n]
                if n >= max(6, 4 * q) and not any(all(s[k] == s[k + d] for k in range(n - d)) for d in range(1, q)):
                    out.append((i, n, q))
                i = j
            i += 1
    return sorted(out)


def planted(key, w):
    if key is None or not w:
        return w
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_digest(key, text, plant=True):
    w = blank_words(text)
    if plant:
        w = planted(key, w)
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (key, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


word_lists = st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("ab"), min_size=1, max_size=5), st.integers(0, 9)), max_size=4)


@settings(max_examples=300, deadline=None)
@given(word_lists)
def test_runs_are_all_maximal_ones(parts):
    docs = [head + body * times + head for head, body, times in parts]
    hashes = np.array([zlib.crc32(w.encode()) for d in docs for w in d], np.uint64)
    got = P.runs_of(hashes, np.cumsum([0] + [len(d) for d in docs]))
    assert got == [(r, *x) for r, d in enumerate(docs) for x in brute_runs(d)]


def test_runs_of_odd_rows(docs_of, clashing):
    rng = random.Random(5)
    pairs = [(k, t) for k, t in enumerate(ODD_TEXTS) if not t or len(t) < 60000]
    pairs += [(None, "a b " * 9), (7, "x y z " * 5 + "end"), (7, "x y z " * 5 + "end"), (-5, "no run at all here")]
    pairs += [(100 + k, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 120)))) for k in range(60)]
    docs = docs_of(pairs, clashing)
    got = P.run_digests(P.planted_periods(docs))
    assert Counter(map(tuple, got.collect())) == Counter(brute_digest(*p) for p in pairs)
    assert P.run_digests(docs_of([])).count() == 0


def test_long_run_collapses(docs_of):
    n = 200_000
    row = P.periodic_runs(docs_of([(1, "word " * n)])).first()
    assert row.collapsed == "word" and [tuple(r) for r in row.runs] == [(0, n, 1)] and row.strongest.length == n


def test_op11_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(blank_words(d.text)) < 700]
    got = {r.doc_id: tuple(r) for r in Q.op11_descending_lcp_runs(spark, SF).collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[d.doc_id] == brute_digest(d.doc_id, d.text) for d in short)
    assert any(r[1] for r in got.values())


# --- op12 ---------------------------------------------------------------------


def brute_audit(codes):
    """Least (cost, audit) by trying all edits with memory."""
    follow, memo = (0, 0, 1, 0), {}

    def go(i, state, room):
        key = (i, state, room)
        if key in memo:
            return memo[key]
        found = [(0, "")] if i == len(codes) and state in (T.BEGIN, T.ASSISTANT) else []
        steps = []
        if i < len(codes):
            steps.append((3, "D", i + 1, state, 4))
            if codes[i] < 8:
                late, kind = codes[i] >> 2, codes[i] & 3
                if kind == 2 and state == T.BEGIN:
                    steps.append((late, "K", i + 1, T.SYSTEM, 4))
                if kind == follow[state]:
                    steps.append((late, "K", i + 1, (T.USER, T.ASSISTANT)[kind], 4))
                steps.append((2 + late, "R", i + 1, (T.USER, T.ASSISTANT)[follow[state]], 4))
        if room:
            steps.append((2, "I", i, (T.USER, T.ASSISTANT)[follow[state]], room - 1))
        for cost, edit, j, s, left in steps:
            rest = go(j, s, left)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        memo[key] = min(found) if found else None
        return memo[key]

    return go(0, T.BEGIN, 4)


codes = st.lists(st.sampled_from([0, 1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), max_size=10).map(bytes)


@pytest.mark.parametrize("piece", [2, 5, 32])
def test_alignment_is_cheapest_and_least(piece, monkeypatch):
    monkeypatch.setattr(T, "PIECE", piece)

    @settings(max_examples=250, deadline=None)
    @given(codes, st.lists(st.integers(0, 10), max_size=3))
    def check(turns, cuts):
        want = brute_audit(turns)
        cost, audits = T.aligned(turns)
        assert (cost, "".join(audits)) == want
        edges = [0, *sorted(min(c, len(turns)) for c in cuts), len(turns)]
        runs = [turns[a:b] for a, b in zip(edges, edges[1:])]
        ends = [list(T.CLOSING)]
        for r in reversed(runs):
            m = T.matrix(r)
            ends.append(T._before([m[4 * e:4 * e + 4] for e in range(4)], ends[-1]))
        assert ends.pop()[T.BEGIN] == want[0]
        state, audit = T.BEGIN, ""
        for r, to_go in zip(runs, reversed(ends)):
            state, found = T.traced(r, to_go)[state]
            audit += "".join(found)
        assert audit + "I" * (T.CLOSING[state] // 2) == want[1]

    check()


def brute_report(rows):
    """The report's rows from (conv_id, turn, role, text, gone) in any order."""
    groups = defaultdict(list)
    for conv, turn, role, text, gone in rows:
        groups[conv]
        if not gone:
            role, text = (" " if x is None else x for x in (role, text))
            groups[conv].append((turn, role, text))
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        seen, counts, kinds, codes_ = set(), Counter(), [], []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            kinds.append("uas".find(role[:1]) if role[:1] and role[:1] in "uas" else 3)
            codes_.append(kinds[-1] + (8 if fault in ("blank", "duplicate") else 4 if fault else 0))
        illegal = sum((a, b) not in ((2, 0), (0, 1), (1, 0)) for a, b in zip(kinds, kinds[1:]))
        known = {t for t, _, _ in turns if t is not None}
        cost, audit = brute_audit(bytes(codes_))
        lines, state, at = [], T.BEGIN, 0
        for edit in audit:
            kind = (0, 0, 1, 0)[state]
            role, text = ("user", "assistant")[kind], ""
            if edit != "I":
                _, old, text = turns[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "K":
                    role, kind = old, kinds[at - 1]
            state = (T.USER, T.ASSISTANT, T.SYSTEM)[kind]
            lines.append(f"{role}:{text}")
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                    cost, audit, sha("\n".join(lines))))
    return Counter(out)


CONV = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    return out


def odd_conversations():
    rng = random.Random(11)
    rows = [(None, 1, "user", "No key."), (None, None, None, None), (1, None, "user", None), (2, 1, None, "Hm."), (2, 2, "", "Empty role."), (2, 3, "tool", "Out!")]
    rows += [(3, 5, "user", "Same."), (3, 5, "user", "Same."), (3, 5, "assistant", "Same."), (4, 1, "system", "Only."), (5, -3, "user", "ü 　"), (6, 1, "usr", "By initial.")]
    for conv in range(10, 60):
        n = rng.randint(1, 9)
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system"]) if rng.random() < .4 else ("user", "assistant")[t % 2],
                  rng.choice(["Yes.", "No", " ", f"Number {t}?", "What!"])) for t in range(n)]
    rows += [(99, t, ("user", "assistant")[(t // 7 + t) % 2], rng.choice(["Yes.", f"{t}.", f"{t}"])) for t in range(150)]  # hot
    return rows


@pytest.mark.parametrize("inside,parts", [(4096, 1), (4096, 7), (5, 7)])
def test_report_of_odd_rows(spark, monkeypatch, inside, parts):
    rows = odd_conversations()
    table = spark.createDataFrame(rows, CONV).repartition(3)
    for name in ("pid", "kind", "gone", "mark", "duplicate", "id", "first", "copy"):
        table = table.withColumn(name, F.lit(None).cast("string"))
    monkeypatch.setattr(T, "INSIDE", inside)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        spoilt = T.damaged(table)
        got = T.repair_report(spoilt, gone=F.col("gone")).collect()
        plain = T.repair_report(table).collect()
        edits = T.repaired_turns(table).orderBy("part", "seq", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert Counter(map(tuple, got)) == brute_report(brute_damage(rows))
    assert Counter(map(tuple, plain)) == brute_report([(*r, False) for r in rows])
    by_conv = defaultdict(list)
    for e in edits:
        by_conv[e.conv_id].append(e)
    for r in plain:
        mine = by_conv[r.conv_id]
        assert "".join(e.edit for e in mine) == r.audit
        assert sha("\n".join(f"{e.role}:{e.text}" for e in mine if e.edit != "D")) == r.repaired_sha256


def test_report_of_empty_and_dropped(spark):
    assert T.repair_report(spark.createDataFrame([], CONV)).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x.")], CONV)
    assert [tuple(r) for r in T.repair_report(gone, gone=F.lit(True)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_op12_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, Q.op12_target_alignment(spark, SF).collect())) == brute_report(brute_damage(rows))


# --- op13 ---------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                windows[tuple(w[k:k + n])].add(item)
    out = []
    for key, text in docs:
        w = plain_words(text)
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k:k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    ids |= {str(i) for i in found if i is not None}
        out.append((key, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [2_000_000, 200])
def test_hits_of_odd_rows(spark, docs_of, clashing, block_bytes):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "x", "on2", "a-b", "ZED", "word", "été"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 40]))) for k in range(12)] + [(None, "an item without id"), (4, "Repeated item"), (4, "Repeated item"), (20, None), (21, ""), (22, "...")]
    items += [(100 + k, "question what is the right answer to all of this " + text(4)) for k in range(6)] + [(30, text(2500))]
    pairs = list(enumerate(ODD_TEXTS)) + [(None, text(300)), (7, "the repeated ITEM."), (7, "the repeated ITEM."), (9, "is an item without, id")]
    pairs += [(50 + k, text(30) + " " + (rng.choice(items)[1] or "") + "; " + text(5)) for k in range(20)]
    docs = docs_of(pairs, clashing)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit("x")).withColumn("doc_id", F.lit("y"))
    got = W.contamination_digests(docs, table, block_bytes=block_bytes)
    assert Counter(map(tuple, got.collect())) == brute_hits(pairs, items)
    assert W.contamination_digests(docs_of([]), table).count() == 0
    none = W.contamination(docs, table.limit(0)).collect()
    assert len(none) == len(pairs) and not any(r.n_hit or r.starts or r.item_ids for r in none)


def test_spans_are_hit_words(docs_of, spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = docs_of([(1, f"zero {item} twelve and one two three four five six seven eight nine ten")])
    r = W.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert (r.starts, r.ends, r.item_ids, r.n_hit) == ([1, 14], [12, 24], ["5"], 21)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), min_size=1, max_size=8), min_size=1, max_size=5), st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=60), st.integers(1, 4))
def test_occurrences_of_short_patterns(items, doc, n):
    patterns = W.Patterns([(str(k), " ".join(w).encode()) for k, w in enumerate(items)], n)
    data = pa.array([" ".join(doc)]).cast(pa.large_binary())
    (_, _, raw, offsets), = list(W.hashed_words.chunks(data))
    begin, pattern = patterns.occurrences(W.words_of(raw, offsets))
    texts = sorted({tuple(w[k:k + n]) for w in items for k in range(max(1, len(w) - n + 1))})
    want = Counter((k, len(t)) for t in texts for k in range(len(doc) - len(t) + 1) if tuple(doc[k:k + len(t)]) == t)
    assert Counter(zip(begin.tolist(), patterns.words[pattern].tolist())) == want
