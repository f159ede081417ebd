"""Line-first cleaning and disclosure control against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlake.llm import disclosure_pii as D
from ledgerlake.llm import line_cleaning as L

from .conftest import ODD_TEXTS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def line_fails(line):
    n = len(WORD.findall(line))
    if n <= 30 and any(p in line.lower() for p in L.BOILERPLATE):
        return True
    return any(3 <= len(re.findall(p, line)) >= n / share for p, share in
               ((r"[|•·»«›‹→←]", 5), (r"[#*$%&<>~^=_\\]{2,}", 3), (r"[!?]{2,}", 3)))


def judged(text):
    text = text or ""
    failed = base(text)[-1]
    left = "\n".join(x for x in text.split("\n") if not line_fails(x))
    return *base(text), not failed and 100 * (len(text) - len(left)) <= 50 * len(text), left


def some_texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["$$$", "|", "a.", "STOP!!", "ünï", "x#y"]
    out = []
    for _ in range(60):
        lines = [" ".join(rng.choices(words[:rng.randrange(5, len(words))], k=rng.randrange(0, 40))) + rng.choice([".", "", " "]) for _ in range(rng.randrange(1, 9))]
        lines += rng.choices(["All rights reserved.", "Home | News | About | Contact", "GO!! NOW!! BUY!!", "\t", "see the terms of use", "a long line of prose " * 9 + "on the terms of use"], k=rng.randrange(0, 4))
        rng.shuffle(lines)
        out.append("\n".join(lines))
    return out


def test_quality_of_odd_rows(spark, docs_of, clashing):
    pairs = list(enumerate([*ODD_TEXTS, *some_texts()])) + [(None, "no key"), (7, "same " * 60), (7, "same " * 60)]
    docs = docs_of(pairs, clashing)
    got = Counter(map(tuple, L.quality_report(docs).collect()))
    assert got == Counter((k, *judged(t)) for k, t in pairs)
    left = L.cleaned_documents(docs)
    assert left.columns == docs.columns
    want = Counter((k, judged(t)[-1], len(judged(t)[-1])) for k, t in pairs if judged(t)[-2])
    assert Counter((r.doc_id, r.text, r.n_chars) for r in left.select("doc_id", "text", "n_chars").collect()) == want
    assert L.quality_report(docs_of([])).count() == 0 == L.cleaned_documents(docs_of([])).count()


def test_quality_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, L.quality_report(docs).collect()))
    assert got == sorted((r.doc_id, *judged(r.text)) for r in docs.collect())


def test_quality_plan_is_native(spark):
    plan = L.quality_report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def plain_base(text):
    """The patterns over the whole text at once."""
    out = [(*m.span(), "email") for m in D.EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in D.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in D.CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((*m.span(), "card"))
    return out + [(*m.span(), "phone") for m in D.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def pii_texts():
    rng = random.Random(8)
    parts = ["4736962573099581", "4736 9625 7309 9581", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.255.255", "a.b@c.d", "x@y", "@", "a@b.c@d.e", ".", "+1 (017) 555-7713", "+12", "+ 1234567890",
             "+1234567890123456", "9" * 30, "-", " ", "é", "\n", "1-2 3", "%", "me+you@mail-1.example.co.uk", "_", ",", "192.168.0.1,", "4111-1111-1111-1111", "0000000000000"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(1500)]


def test_base_spans():
    for t in [*pii_texts(), *(x or "" for x in ODD_TEXTS), "1" * 5000 + ".1", "a" * 5000 + "@" + "b" * 5000]:
        assert sorted(D.base_spans(t)) == sorted(plain_base(t)), t


def brute_terms(pairs, support, least):
    """(entity, term) -> disclosure, by counting."""
    n = len(pairs)
    has, joint, seen, df = Counter(), Counter(), defaultdict(set), Counter()
    for _, t in pairs:
        t = t or ""
        spans = plain_base(t)
        df.update({D.term_of(w) for w in WORD.findall(t)})
        has.update({D.entity_of(t[s:e], k) for s, e, k in spans})
        for (e, w), c in D.contexts(t, spans).items():
            joint[e, w] += 1
            seen[e, w].add(c)
    out = {}
    for (e, w), j in joint.items():
        if len(seen[e, w]) >= support and has[e] < n:
            d = math.log(n * j / (max(df[w], j) * has[e])) / math.log(n / has[e])
            if d >= least:
                out[e, w] = d
    return out


def disclosing_pairs():
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(50)]
    pairs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=30)
        if k % 6 == 0:
            words[10:12] = ["Chairwoman", "ann.lee@mail.example.com", "zebrafish."]
        if k % 10 == 0:
            words += ["Chairwoman"]
        pairs.append((k, " ".join(words)))
    pairs += [(100 + k, "Copies of Onlyhere one.person@mail.example.com text") for k in range(9)]
    return pairs


def test_disclosing_terms(docs_of, clashing):
    pairs = disclosing_pairs() + [(200 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "1.2.3.4")]
    rows = docs_of(pairs, clashing).select("doc_id", "text")
    near = rows.select("text").mapInArrow(D._context_rows(D.WINDOW), "digest binary, entity string, term string, seen long")
    want = brute_terms(pairs, 3, 0.5)
    for most in (100, 0):
        got = {(r.entity, r.term): r.disclosure for r in D.disclosing_terms(rows, near, 3, 0.5, most).collect()}
        assert got == pytest.approx(want)
    assert ("email:ann.lee@mail.example.com", "zebrafish") in want
    assert not any("onlyhere" in w for _, w in want)  # copies of one context are no evidence


def test_found_and_sanitised(spark, docs_of, clashing):
    pairs = disclosing_pairs() + [(200 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(300 + k, t) for k, t in enumerate(pii_texts()[:80])] + [(None, "x 1.2.3.4"), (1, "again a@b.cd"), (1, "again a@b.cd")]
    docs = docs_of(pairs, clashing)
    terms = defaultdict(dict)
    for (e, w), d in brute_terms(pairs, D.SUPPORT, D.GENERALISE).items():
        terms[e][w] = d
    want = Counter()
    for k, t in pairs:
        t = t or ""
        spans = plain_base(t)
        own = {}
        for e in {D.entity_of(t[s:x], kind) for s, x, kind in spans}:
            for w, d in terms[e].items():
                own[w] = max(d, own.get(w, 0))
        more = D.term_spans(t, set(own), spans)
        n = Counter(s[2] for s in spans)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], D.KINDS.index(x[2])))).encode()).hexdigest()
        want[k, n["email"], n["ip"], n["card"], n["phone"], digest, D.joined(spans + more), D.sanitised(t, spans + more, {w for w, d in own.items() if d >= D.REMOVE})] += 1
    got = Counter(map(tuple, D.found_and_sanitised(docs).collect()))
    assert got == want
    assert any("term:" in r[6] for r in got)
    out = D.sanitised_documents(docs)
    assert out.columns == docs.columns
    texts = Counter((k, s, len(s)) for (k, *_, s), n in want.items() for _ in range(n))
    assert Counter((r.doc_id, r.text or "", r.n_chars or 0) for r in out.select("doc_id", "text", "n_chars").collect()) == texts
    assert D.found_and_sanitised(docs_of([])).count() == 0 == D.sanitised_documents(docs_of([])).count()


def test_sanitised_leaves_no_base_value():
    for t in pii_texts()[:400]:
        s = D.sanitised(t, D.base_spans(t), set())
        assert all(t[a:b] not in s or k != "email" for a, b, k in D.base_spans(t))
    assert D.sanitised("Dr Ann of 4711 a@b.cd", [(3, 6, "term"), (10, 14, "term"), (15, 21, "email")], {"ann"}) == "Dr  of <NUMBER> <EMAIL>"


def test_few_contexts_are_decided(docs_of):
    """One or two contexts, and terms far from the entity, disclose where the corpus is large enough."""
    common = " ".join(f"v{k}" for k in range(40))
    pairs = [(k, common) for k in range(2500)]
    pairs += [(3000, f"Quetzal {common} ann.lee@mail.example.com and +1 (017) 555-7713")]
    pairs += [(3001 + k, f"{common} {k} 10.1.2.3 x{k} Okapi v1") for k in range(2)]
    pairs += [(3010, f"{common} copied@mail.example.com {common} Numbat")] * 2
    pairs += [(3020 + k, f"v1 v2 10.9.9.9 v{k} once{k}") for k in range(40)]
    spans = {(r.doc_id, r.spans): r.sanitised for r in D.found_and_sanitised(docs_of(pairs)).collect()}
    terms = {k: [p for p in s.split(",") if p.startswith("term:")] for k, s in spans}
    assert terms[3000] == ["term:0:7", f"term:{len(common) + 34}:{len(common) + 37}"]
    assert any(s.startswith("<NAME> v0") for (k, _), s in spans.items() if k == 3000)  # replaced, not removed
    okapi = pairs[2501][1].index("Okapi")
    assert f"term:{okapi}:{okapi + 5}" in terms[3001]
    assert len(terms[3010]) == 1  # a copy changes nothing
    assert not any(terms[3020 + k] for k in range(40))  # chance, beside an entity of forty texts
    assert not any(v for k, v in terms.items() if k < 2500)


def test_base_spans_are_the_patterns_matches():
    import random

    rng = random.Random(8)
    for _ in range(20000):
        text = "".join(rng.choices("a1@.-+%_ é2550", k=rng.randint(0, 24)))
        want = [(*m.span(), "email") for m in D.EMAIL.finditer(text)]
        want += [(*m.span(), "ip") for m in D.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in D.base_spans(text) if s[2] in ("email", "ip")] == want


def test_base_scan_of_long_runs_is_linear():
    import time

    began = time.process_time()
    n = 2_000_000
    for text, spans in (("@" + "a" * n, 0), ("1" * n + "...", 0), ("x 1.2.3." + "0" * 5000 + "1 y", 1), ("1.2.3." + "9" * 5000, 0), ("a@" * n, 0),
                        ("+" + "1 " * n, 0), ("4" * n, 0), ("1." * n, n // 4)):
        assert len(D.base_spans(text)) == spans
    assert time.process_time() - began < 30
