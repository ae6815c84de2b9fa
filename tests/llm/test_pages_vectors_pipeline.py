"""Archives, extraction, vectors and the pipeline."""

import base64
import collections
import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prizelens.llm import extraction, vectorgraph, warc
from prizelens.llm.components import components
from prizelens.llm.labelled_pages import labelled_pages
from prizelens.session import new_run_dir

PAGES = "page_id long, url string, html string, digest string, payload binary"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7} ü</p>", "x", None) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "http://h/a\r\nb%0A", "", None, None), (42, "u", "\r\n\r\n" * 9, None, None)]
    rows += [(43, "u", "y" * 300_000, None, None), (43, "u", "y" * 300_000, None, None), (None, "u", "no id", None, None)]
    return spark.createDataFrame(rows, PAGES).repartition(4).cache()


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark, pages):
    folder = new_run_dir(spark, "warc-test")
    index = warc.write_archives(pages, folder, file_bytes=4_000)
    assert index.select("file").distinct().count() > 1
    got = warc.read_archives(index, folder, gap=100, most=2_000).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    best = collections.defaultdict(lambda: -1)
    for r in rows:
        best[sha(r.html)] = max(best[sha(r.html)], -1 if r.page_id is None else r.page_id)
    html = {r.page_id: r.html or "" for r in rows}
    urls = {r.page_id: r.url for r in rows}
    for x in got:
        payload = html[x.page_id].encode()
        assert (x.payload_bytes, x.payload_digest, x.url) == (len(payload), sha(html[x.page_id]), urls[x.page_id])
        first = x.page_id is None or best[x.payload_digest] == x.page_id
        assert x.record_type == ("response" if first else "revisit")
        assert x.refers_to == (None if first else best[x.payload_digest])
        assert (bytes(x.payload) == payload) if first else x.payload is None
    some = index.where("page_id in (3, 41)")
    assert {x.page_id for x in warc.read_archives(some, folder).collect()} == {3, 41}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_near_ranges_are_read_together():
    rows = [(0, 10), (10, 5), (100, 10), (1000, 50)]
    got = [(a, b, len(x)) for a, b, x in warc.ranges(rows, gap=90, most=500)]
    assert got == [(0, 110, 3), (1000, 1050, 1)]
    assert [x[:2] for x in warc.ranges(rows, gap=2000, most=20)] == [(0, 15), (100, 110), (1000, 1050)]


@pytest.fixture(scope="module")
def model():
    return extraction.train(labelled_pages())


def test_held_out_pages(model):
    right = total = got_words = 0
    for page in labelled_pages(150, seed=99):
        blocks, texts, _ = extraction.read_page(page)
        want = collections.Counter(
            w for b, t in texts if (blocks[b][4] if blocks[b][4] >= 0 else 1) for w in t.split()
        )
        got = collections.Counter(extraction.main_texts([page], *model)[0].split())
        right += sum((want & got).values())
        total += sum(want.values())
        got_words += sum(got.values())
    assert 2 * right / (total + got_words) > 0.97


def test_awkward_pages(model):
    html = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<article><h1>Big &amp; small</h1><p>One<b>bold</b>  two&nbsp;three<br>four.<p>Five <!-- no --> six <a href=x>seven</a>."
        "<script>if (a < b) { '</p>' }</script><div class=ad>Buy now</div><p>Eight &lt;nine&gt; &#233;.</p></article>"
        "<div id='comments'><p>First!</p></div><footer>(c) me</footer></body></html>"
    )
    assert extraction.main_texts([html], *model)[0] == "Big & small Onebold two three four. Five six seven . Eight <nine> é.".replace(
        "seven .", "seven."
    )
    assert extraction.main_texts(["", "   ", "<", "<p", "</div></p>", "<!-- open"], *model)[0] == ""
    long = "<article>" + "<p>word word word.</p>" * 3000 + "</article>"
    assert extraction.main_texts([long], *model)[0].count("word word word.") == 3000
    assert len(extraction.main_texts(["<div>" * 3000 + "deep"], *model)) == 1


@pytest.mark.parametrize("inside, want", [
    ("<p>We know <button>Share that holds.</p><p>Second one here.</p>", "We know Second one here."),
    ("<p>One two three.</p><video src=v><p>Second one here.</p>", "One two three. Second one here."),
    ("<p>One <math><mi>x</mi><mo>=</mo><mi>y</mi><annotation encoding=t>x{=}y</annotation></math> holds.</p>", "One x=y holds."),
    ("<p>One <svg><svg><text>in</text></svg><text>inner</text></svg> two three.</p>", "One two three."),
    ("<object data=f><p>The fallback is a paragraph.</p></object>", "The fallback is a paragraph."),
    ("<p>One <button><div>Share</div></button> two three.</p>", "One two three."),
    ("<p>One <svg/> two <select><option>a<option>b</select>three.</p>", "One two three."),
    ("<div><p>One two three.</p><canvas></div><p>Second one here.</p></canvas>", "One two three. Second one here."),
])
def test_elements_without_text_take_nothing_along(model, inside, want):
    tail = "<p>The last sentence of the article stays where it is.</p>"
    page = f"<html><body><article><h1>A headline</h1>{inside}{tail}</article></body></html>"
    assert extraction.main_texts([page], *model)[0] == f"A headline {want} The last sentence of the article stays where it is."


@pytest.mark.parametrize("part", ["<svg>", "<svg ", "<button>", "<svg></svg", "</svg>", "<select><div>", "<video><p></video>"])
def test_elements_without_text_take_linear_time(model, part):
    page = part * 40_000
    started = time.perf_counter()
    extraction.read_page(page)
    assert time.perf_counter() - started < 10


def test_extraction_of_a_table(spark, pages):
    out = extraction.extract_text(pages, sample=60)
    assert set(out.columns) == {*pages.columns, "text", "n_chars"}
    got = out.collect()
    assert len(got) == pages.count() and all(x.n_chars == len(x.text) for x in got)
    assert all(x.text == "" for x in got if not x.html)
    assert extraction.extract_text(pages.limit(0), sample=20).count() == 0


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(1)
    blocks = [[p, d, int(rng.integers(14)), 0, -1, 5, 0, 0] for p, d in ((-1, 0), (0, 1), (0, 1), (1, 2), (1, 2), (2, 2))]
    forest = extraction.Forest([blocks])
    unary, pair = rng.normal(size=6), rng.normal(size=(14, 2, 2))
    got = forest.marginals(unary, pair)[0]
    weight, on = 0.0, np.zeros(6)
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        s = sum(unary[i] * y[i] for i in range(6))
        s += sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, 6))
        weight += np.exp(s)
        on += np.exp(s) * np.array(y)
    assert got == pytest.approx(on / weight)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, j) for j in range(200, 260)] + [(5, 5), (300, 299), (299, 300)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 141)} | {j: 7 for j in range(200, 260)} | {300: 299}
    assert got == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((n, rng.normal(size=16).tolist(), label, "a", 1))
            n += 1
    for _ in range(150):  # a group of near copies, some of them exact
        base = np.arange(1.0, 17.0) + (rng.normal(size=16) * 0.4 if rng.random() < 0.8 else 0)
        rows.append((n, base.tolist(), 1, "a", 1))
        n += 1
    for bad in (None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]):
        rows.append((n, bad, 1, "a", 1))
        n += 1
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string, kept int"), rows


def test_linked_vectors(vectors):
    df, rows = vectors
    got = vectorgraph.linked_vectors(df).collect()
    assert len(got) == len(rows)
    good = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    m = np.array([r[1] for r in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    same = np.array([r[2] for r in good])
    hit = (m @ m.T >= 0.98) & (same[:, None] == same[None, :])
    np.fill_diagonal(hit, False)
    ids = np.array([r[0] for r in good])
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], 1 << 40).min(1))
        if (new == label).all():
            break
        label = new
    want = {i: (int(k), int(c)) for i, k, c in zip(ids, hit.sum(1), label)}
    for x in got:
        assert (x.n_links, x.component_id) == want.get(x.vec_id, (0, x.vec_id))
        assert x.kept == (x.vec_id == x.component_id)
    assert vectorgraph.linked_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("groups, size, others", [(2, 300, 0), (10, 80, 0), (8, 100, 200), (2, 300, 100)])
def test_groups_of_near_copies_without_bridges_are_found(groups, size, others):
    rng = np.random.default_rng(groups)
    v = np.concatenate([c + 0.01 * rng.normal(size=(size, 32)) for c in rng.normal(size=(groups, 32))])
    v = np.concatenate([v, rng.normal(size=(others, 32))])
    rows = pd.DataFrame({"nid": np.arange(len(v)) * 3, "embedding": v.tolist(), "n": 1})
    members = rows.merge(vectorgraph.build_graph(rows), on="nid")
    got = vectorgraph.searcher(0.98, 16)(rows, members).groupby("nid")["links"].sum().to_numpy()
    m = vectorgraph.matrix(rows["embedding"])
    assert (got == (m @ m.T >= 0.98).sum(1) - 1).all()


@pytest.mark.parametrize("found", [True, False])
def test_labels_whose_links_are_missed_are_compared_in_full(vectors, monkeypatch, found):
    df, rows = vectors
    want = sorted(map(str, vectorgraph.linked_vectors(df).collect()))
    if not found:  # a search that finds nothing
        monkeypatch.setattr(vectorgraph, "found_links", lambda classes, *_: classes.select(
            "nid", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("target")))
    monkeypatch.setattr(vectorgraph, "CHUNK_ROWS", 40)
    assert sorted(map(str, vectorgraph.linked_vectors(df).collect())) == want


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    from prizelens.llm.common import stored

    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, sf), "pipeline-test")
        assert after.columns == columns
        counts.append((name, before.count(), after.count()))
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert counts[0][1] > counts[0][2] and counts[3][2] > counts[3][1]
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert last.where("not lossless").count() == 0 and last.count() == before.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    awkward = docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward, sf).collect()
