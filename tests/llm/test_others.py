"""Vectors, pages and the pipeline."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest

import corpus_pipeline
from voxlake.llm import html_extraction as extraction
from voxlake.llm.common import table
from voxlake.llm.topk import exact_top_k

SF = "/root/testdata/sf0.001"


def brute(vectors, k=10):
    sound = {i: np.floor(1024 * np.array(v, float)).astype(object) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in sound if i % 100 == 0):
        width = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
        best = sorted(((-width(sound[q], v), i) for i, v in sound.items() if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1.0, 2e5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.normal(size=24)], "x") for i in range(330)]
    rows[7:12] = [(7, None, "x"), (8, [1.0, None], "x"), (9, [float("nan")] * 24, "x"), (10, [float("inf")] * 24, "x"), (11, [], "x")]
    rows[21:24] = [(i, rows[20][1], "x") for i in (21, 22, 23)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = {tuple(r) for r in exact_top_k(df, "id % 100 = 0", part_rows=64, query_rows=2).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute([(i, v) for i, v, _ in rows])
    assert exact_top_k(df.limit(0), "id % 100 = 0").count() == 0


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (200, [0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in exact_top_k(df, "id % 100 = 0").select("query_id", "rank", "vec_id").collect()} == {(0, 1, 1), (0, 2, 200), (200, 1, 1), (200, 2, 0)}


def test_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    wrong = 0
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in extraction.extract_main_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", sources[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        wrong += r.text != "\n".join(p for p in parts if p)
    assert wrong == 0


def test_other_layouts():
    odds, bias, trees = extraction.model()
    good = total = 0
    for source in extraction.layouts(200, seed=4242):
        want = {t.replace(extraction.MARK, "") for t in extraction.Page(source).text if t and extraction.MARK in t}
        page = extraction.Page(source.replace(extraction.MARK, ""))
        x = page.features(odds)
        margin = np.full(len(x), bias) + sum(extraction.predict_tree(t, x) for t in trees)
        got = set(page.decode(1 / (1 + np.exp(-margin))).split("\n")) - {""}
        good += len(got & want)
        total += len(got | want)
    assert good / total > 0.95


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "plain words only", "x"), (4, "u", "<p>a<p>b<div", "x"), (5, None, "<" * 500, "x"), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10, "x"), (7, "u", "<!-- never closed <p>x", "x"), (8, "u", "<script>if (a<b) { '</p>' }</script><article><p>One &amp; two&nbsp;three &#8364;<b>x</b></p></article>", "x"), (None, "u", "<p>no id</p>", "x")]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == 9 and got[1] == got[2] == got[7] == "" and got[8] == "One & two three €x"
    assert extraction.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["button", "object", "video", "canvas", "svg", "select", "noscript", "audio", "datalist", "xmp", "math"])
def test_elements_that_are_no_raw_text(spark, tag):
    said = "The river rose after the long rain, and people of the village carried sand to the dam. "
    before = f"<html><body><div class=menu><a href=1>Home</a></div><article><h1>Flood in the valley</h1><p>{said * 3}</p>"
    after = f"<p>{said * 2}It held, they said.</p><p>{said * 2}Nobody was hurt.</p></article><div class=footer>&copy; all</div></body></html>"
    rows = [(1, "u", f"{before}<{tag}>{after}"), (2, "u", f"{before}<p>{said}</p><{tag}></{tag}>{after}"), (3, "u", f"{before}<{tag}>{said * 3}</{tag}>{after}")]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("It held, they said." in t and "Nobody was hurt." in t for t in got.values())
    read = extraction.Page(f"<p>see <{tag}>inner words</{tag}> here</p>")
    assert "inner words" in " ".join(t for t in read.text if t)
    if tag == "math":
        assert "see inner words here" in read.text


def test_hierarchy():
    page = extraction.Page("<div class=ad><p>one</p></div><p>two</p>")
    chance = np.array([0.5, 0.001, 0.6, 0.6, 0.9, 0.9])
    assert page.decode(chance) == "two"  # nothing is kept inside what is dropped


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}, name
        kept = out
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert 0.8 * docs.count() < len(ids) < docs.count()
    assert "token = \"24be" not in "".join(r.text or "" for r in kept.collect())


def test_pipeline_on_odd_rows(spark):
    rows = [(None, "no id here at all", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a few plain words of text", "en", "s", 25), (4, "a few plain words of text", "en", "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {None, 3}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
