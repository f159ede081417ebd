"""Trained operators: gradients, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from ledgerlake.llm import conv_toxicity as C
from ledgerlake.llm import recurrent_html as R

from .conftest import ODD_TEXTS

MED = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{MED}/documents.parquet")
    labels = spark.read.parquet(f"{MED}/labels.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def net(labelled):
    return C.trained(C.training_rows(*labelled, toxic_rows=300, other_rows=700))


def test_toxicity_held_out(labelled, net):
    docs, labels = labelled
    rows = C.toxicity(docs, labels, net).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert auc(y, p) > 0.93 and (np.array([r.predicted for r in rows]) == y).mean() > 0.93
    assert ((p >= 0) & (p <= 1)).all() and all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_training_rows_are_outside_the_held_out_fold(labelled):
    docs, labels = labelled
    rows = C.training_rows(docs, labels, 50, 70)
    assert sum(y for _, y, _ in rows) <= 50 and len(rows) <= 120 and rows == C.training_rows(docs.repartition(5), labels.repartition(3), 50, 70)
    held = {r.text for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0").select("text").collect()}
    own = {r.text for r in docs.where("crc32(cast(doc_id as string)) % 5 != 0").select("text").collect()}
    assert all(t in own for t, _, _ in rows) and held


def test_toxicity_of_odd_rows(spark, docs_of, clashing, net):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "no key"), (5, "you idiot"), (5, "you idiot")]
    docs = docs_of(pairs, clashing)
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (5, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    rows = C.toxicity(docs, labels, net).collect()
    assert len(rows) == len(pairs)
    empty = {r.score for r in rows if r.doc_id in (0, 1, 2, 3)}
    assert len(empty) == 1
    assert len({r.score for r in rows if r.doc_id == 5}) >= 1
    only = C.toxicity(docs, labels).collect()  # one label only: the share of toxic labels
    assert {r.score for r in only} <= {0.0, 1.0}
    assert C.toxicity(docs_of([]), labels).count() == 0
    assert C.toxicity(docs, spark.createDataFrame([], labels.schema)).where("score != 0").count() == 0


def test_long_texts_are_scored_whole(net, monkeypatch):
    s = C.Scorer(net)
    text = " ".join(f"word{k % 97}" for k in range(500)) + " idiot moron scum"
    whole = s.scores([text])[0]
    monkeypatch.setattr(C, "PIECE", 50)
    assert C.Scorer(net).scores([text])[0] == pytest.approx(whole, rel=1e-5)
    assert whole > C.Scorer(net).scores([text[:2000]])[0]


def test_best_threshold():
    x, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0])
    assert C.best_threshold(x, y) == 1.5


def test_lstm_gradient():
    net = R.Labeller(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    pages = [R.features([("one two", ("p",), 0), ("three", ("li", "nav"), 5), ("four", ("div",), 0)]), R.features([("x", ("p",), 0)])]
    labels = [np.array([1.0, 0, 1]), np.array([0.0])]

    def loss():
        return -np.mean(np.concatenate([y * np.log(p) + (1 - y) * np.log(1 - p) for p, y in zip(net.scores(pages), labels, strict=True)]))

    memory: dict = {}
    before = {k: v.copy() for k, v in net.w.items()}
    net.step(pages, labels, 0.0, memory)
    assert all((net.w[k] == before[k]).all() for k in before)
    rng = np.random.default_rng(0)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb", "out", "bias", "path", "word"):
        grad = memory[name][0] * 10  # the first moment after one step is a tenth of the gradient
        places = np.argwhere(np.abs(grad) > 1e-6)
        assert len(places), name
        for at in rng.permutation(len(places))[:4]:
            at = tuple(places[at])
            old, step = net.w[name][at], 1e-3
            net.w[name][at] = old + step
            up = loss()
            net.w[name][at] = old - step
            down = loss()
            net.w[name][at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-5), name


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="Page main2"><nav><ul><li><a href="/x">Home</a><li>Two</ul></nav>
    <!-- no --><article><h1>A &amp; B</h1><p><b>One<br>two<p>Three &copy; <i>four</i>  five</p><script>var a="</p>";</script><p title="a > b">Six</p></article>
    <footer>End"""
    got = R.blocks(page)
    assert [t for t, _, _ in got] == ["Home", "Two", "A & B", "One two", "Three © four five", "Six", "End"]
    assert got[0][1] == ("html", "body", "page", "main", "nav", "ul", "li") and got[0][2] == 4
    assert got[3][1][-1] in ("b", "p") and got[5][1][-2:] == ("article", "p")
    assert R.blocks("") == [] and R.blocks("<p>") == [] and R.blocks("a < b")[0][0].startswith("a")
    assert len(R.blocks("<" * 20000)) <= 1 and R.blocks("<a '" * 2000) is not None


@pytest.fixture(scope="module")
def labeller(spark):
    return R.trained(R.sample_pages(spark.read.parquet(f"{MED}/pages.parquet"), most=120))


def test_main_text_of_held_out_pages(spark, labeller):
    pages = spark.read.parquet(f"{MED}/pages.parquet")
    seen = set(R.sample_pages(pages, most=120))
    rows = [r for r in pages.limit(600).collect() if r.html not in seen]
    got = {r.page_id: r.text for r in R.main_texts(spark.createDataFrame(rows, pages.schema), net=labeller).collect()}
    right = 0
    for r in rows:
        found = R.blocks(r.html)
        inside = "\n".join(t for t, path, _ in found if "article" in path)
        right += got[r.page_id] == inside
    assert right / len(rows) > 0.98


def test_unseen_wrappers(labeller):
    body = ["The committee met again on Tuesday, and it agreed that the bridge would be repaired before winter.", "Members said that costs had risen, but that the work could not wait any longer."]
    page = ("<html><body><div class='navbar'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='content'>" + "".join(f"<p>{b}</p>" for b in body * 3)
            + "</div><div class='comments'><div class='comment'><p>Nice one.</p></div></div><div class='footer'>Imprint</div></body></html>")
    found = R.blocks(page)
    keep = [t for (t, _, _), s in zip(found, labeller.scores([R.features(found)])[0], strict=True) if s >= 0.5]
    assert keep == body * 3


def test_pages_of_odd_rows(spark, labeller):
    htmls = [None, "", " ", "plain text", "<p>", "<article><p>x</p></article>", "<div>" * 3000 + "deep", "<p>word</p>" * 3000]
    rows = [(k, f"u{k}", h, None) for k, h in enumerate(htmls)] + [(None, None, "<p>a</p>", "t"), (3, "u", "<p>a</p>", "t"), (3, "u", "<p>a</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for net in (labeller, None):
        got = R.main_texts(pages, net=net).collect()
        assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(a), str(b)) for a, b, _, _ in rows)
        assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id in (0, 1, 2, 4))
    assert R.main_texts(pages.limit(0)).count() == 0


def test_blocks_of_formulas_and_fallbacks():
    """Only scripts and the like are skipped; what is not closed ends with its parent."""
    page = """<html><head><title>T</title></head><body><article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>
    <p>See <object data=a><b>the plan</b></object> and <canvas>a chart</canvas> <svg><title>Key</title><text>North</text><style>a{}</style></svg></p>
    <noscript>Plain text</noscript><script>var a = 1</script></article></body></html>"""
    assert [t for t, _, _ in R.blocks(page)] == ["So x=2 holds", "See the plan and a chart KeyNorth", "Plain text"]
    assert R.blocks(page)[2][1][-2:] == ("article", "noscript")
    for name in ("math", "svg", "object", "canvas", "noscript", "textarea", "iframe"):
        page = f"<article><p>One</p><div><{name}>in</div><p>Two</p></article><p>Three"
        assert [t for t, _, _ in R.blocks(page) if t != "in"] == ["One", "Two", "Three"], name
        assert [t for t, _, _ in R.blocks(f"<div><p>One</p><{name}>in</other></div><p>Two")][-1] == "Two", name
    assert [t for t, _, _ in R.blocks("<p>One<script>var a")] == ["One"]
    assert len(R.blocks("<p>a<textarea>b</p>" * 20000)) == 20000


def test_a_very_long_page_runs_alone():
    sizes = sorted([5] * 95 + [30] * 200 + [3000] * 3 + [100_000, 300_000])
    runs = list(R.groups(sizes))
    assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])] and runs[-1][1] == len(sizes)
    assert all(b - a <= 96 and (b - a == 1 or (b - a) * sizes[b - 1] <= R.CELLS) for a, b in runs)
    assert runs[-2:] == [(298, 299), (299, 300)] and list(R.groups([])) == []


def test_training_samples_are_bounded(spark):
    """A repeated key gives one text, and copies of a page one page."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)] + [(7, f"copy {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = C.training_rows(docs, labels, 10, 10)
    assert 0 < len(got) <= 20
    pages = spark.createDataFrame([("<p>same</p>",)] * 300 + [(f"<p>{k}</p>",) for k in range(20)], "html string")
    sample = R.sample_pages(pages, most=15)
    assert len(sample) == len(set(sample)) == 15 and sample == R.sample_pages(pages.repartition(5), most=15)
    assert R.sample_pages(pages.limit(0)) == []


@pytest.fixture(scope="module")
def many_labelled(spark):
    """9,000 labelled rows; the toxic ones beyond the first 3,000 by hash have a word of their own, all but one time."""
    from pyspark.sql import functions as F
    ids = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 < 4).cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    first = ids.where((F.col("toxic") == 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).orderBy("h").limit(3000).agg(F.max("h")).first()[0]
    word = F.when(F.col("toxic") == 0, "pleasant").when(F.col("h") <= first, "nastyword").otherwise("zorblaxian")
    rows = ids.select("doc_id", F.concat_ws(" ", F.lit("the talk was"), word, F.concat(F.lit("w"), F.col("doc_id") % 97)).alias("text"), "toxic")
    rows = C.rewritten(rows, "many-labelled")
    return rows.select("doc_id", "text"), rows.select("doc_id", "toxic")


def test_every_labelled_row_is_learnt(spark, many_labelled):
    docs, labels = many_labelled
    net = C.learned(docs, labels)
    a, b = C.Scorer(net).scores(["the talk was zorblaxian w5", "the talk was pleasant w5"])
    assert a >= 0.5 > b
    again = C.learned(docs.repartition(7), labels.repartition(2))
    assert all((net.w[k] == again.w[k]).all() for k in net.w) and (net.thresholds == again.thresholds).all()


def test_thresholds_over_all_rows_are_the_best(spark, many_labelled):
    docs, labels = many_labelled
    rows = docs.join(labels, "doc_id").where("doc_id < 700").withColumn("toxic", (C.F.xxhash64("text") % 3 == 0).cast("int"))
    net = C.ConvNet()
    C._calibrate(net, rows)
    got = rows.collect()
    parts = C.Scorer(net).parts([r.text for r in got])
    x, y = np.array([x for x, _ in parts]), np.array([r.toxic for r in got], np.float32)

    def f1(t):
        return 2 * y[x >= t].sum() / ((x >= t).sum() + y.sum())

    assert f1(net.thresholds[-1]) >= f1(C.best_threshold(x, y)) - 0.01
