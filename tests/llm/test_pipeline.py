"""The pipeline against its stages done by brute force, and each stage on odd rows."""

import hashlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from ledgerlake.llm import disclosure_pii as D
from ledgerlake.llm.prefix_tree_join import without_near_copies

from .conftest import ODD_TEXTS, SF
from .test_cleaning_pii import brute_terms, judged, plain_base
from .test_ids_packing import packing_holds
from .test_jaccard import brute, near_copies


def sanitised_all(pairs):
    terms = defaultdict(dict)
    for (e, w), d in brute_terms(pairs, D.SUPPORT, D.GENERALISE).items():
        terms[e][w] = d
    out = []
    for k, t in pairs:
        spans, own = plain_base(t), {}
        for e in {D.entity_of(t[s:x], kind) for s, x, kind in spans}:
            for w, d in terms[e].items():
                own[w] = max(d, own.get(w, 0))
        spans += D.term_spans(t, set(own), spans)
        out.append((k, D.sanitised(t, spans, {w for w, d in own.items() if d >= D.REMOVE})))
    return out


def test_run(spark):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pairs = [(k, judged(t)[-1]) for k, t in pairs if judged(t)[-2]]
    last = {}
    for k, t in pairs:
        last[t] = max(k, last.get(t, k))
    pairs = sorted((k, t) for t, k in last.items())
    keep = {c for _, _, c in brute(pairs, 5, 80)}
    pairs = sanitised_all([(k, t) for k, t in pairs if k in keep])
    assert 20 < len(pairs) < 200
    packing_holds(map(tuple, entry.queries()["pipeline"](spark, SF).collect()), pairs, 1024)
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_on_odd_rows(spark, docs_of, clashing, name, stage):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, None), (None, "no key"), (None, "no key"), (3, "re peat ed"), (3, "re peat ed"), (9, "re peat ed"), (3, "other")]
    docs = docs_of(pairs, clashing)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in rows) <= Counter(pairs)
    empty = stage(spark, docs_of([], clashing), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_one_of_each_near_group_stays(docs_of, clashing):
    pairs = near_copies(seed=7)
    pairs += [(k, t) for k, t in pairs[:10]] + [(None, pairs[0][1]), (None, "a b c d e f"), (None, "A b c d e f"), (900, ""), (901, None)]
    rows = without_near_copies(docs_of(pairs, clashing), 5, 80, block_sets=5, most_broadcast=0).collect()
    left = Counter((r.doc_id, r.text) for r in rows)
    assert left[900, ""] == left[901, None] == 1 and max(left.values()) == 1
    components = brute(pairs, 5, 80)
    want = {c for _, n, c in components if n and c is not None}
    kept = [r.doc_id for r in rows if r.doc_id is not None and r.text]
    assert set(kept) == want and len(kept) == len(want)
    assert sum(r.doc_id is None for r in rows) == 1


def test_hash_of_texts_is_the_digest(docs_of):
    from ledgerlake.llm.heavy_dedup import digests

    row = digests(docs_of([(1, "é")])).first()
    assert bytes(row.digest) == hashlib.sha256("é".encode()).digest()
