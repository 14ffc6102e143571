"""Edge cases of the corpus operators: malformed pages, numerals, hash collisions, long runs, repeated ids, compiled rules."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.llm import html_extraction as extraction
from voxlake.llm import quality, substring_dedup
from voxlake.llm.common import at_end, cached, drop_staged, held_mb, staged
from voxlake.llm.decontamination import BLOCK_BITS, BLOCK_RADIUS, _probes
from voxlake.llm.language import Model, identify_languages, viterbi, words_of
from voxlake.llm.secrets import find_secrets
from voxlake.llm.tokens import vocabulary
from voxlake.llm.topk import exact_top_k

MALFORMED = {
    "open tags": "<a " * 400_000, "quotes": '<b" ' * 400_000, "quotes, one end": '<b" ' * 400_001 + ">", "quotes and ends": '<b" > ' * 200_001,
    "two quotes": "<b\" > <i' x " * 100_001 + ">", "declarations": "<!" * 500_000, "comments": "<!--" * 300_000, "signs": "<" * 1_000_000, "titles": "<title>" * 200_000,
    "heads": "<head>" * 200_000, "scripts": "<script>" + "</script" * 150_000, "stray ends": "<div>" * 40_000 + "</p>" * 200_000, "items": "<div>" * 40_000 + "<li>" * 60_000,
    "cells": "<table>" + "<td><div>" * 40_000, "one name": "<" + "a" * 1_000_000, "selects": "<select>" * 60_000 + "</select>",
}


@pytest.mark.parametrize("kind", MALFORMED)
def test_malformed_pages_take_linear_time(kind):
    began = time.process_time()
    extraction.Page(MALFORMED[kind])
    assert time.process_time() - began < 5


def test_tags_by_hand():
    read = lambda source: [t for t in extraction.Page(source).text if t]
    assert read("<p title='a > b'>one</p><p title=\"it's\">two</p>") == ["one", "two"]
    assert read("<!-->shown<!-- not --> too") == ["shown too"]
    assert read("a < b and c <3 <p>x") == ["a < b and c <3", "x"]
    assert read("<p>1 <script>var a = '<p>'</script>2 <style>p{}</style>3<title>t</title></p>") == ["1 2 3"]
    assert read("<p>one<title>never closed<p>two") == ["onenever closed", "two"]
    assert read("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]


#: Pages that no generator made: (html, what must be kept, what must go).
PAGES = [
    ("<html><body><div id=top><a href=/>Start</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class='col main-col'><h1>Bridge reopens</h1><p>The old bridge over the river was opened to traffic again on Monday, after two years of repairs and many delays.</p><p>Drivers had used a detour of twelve miles in the meantime, and shops in the town had lost many of their customers.</p></div><div class=footer>Imprint | Contact</div></body></html>",
     ["The old bridge over the river", "Drivers had used a detour"], ["Imprint", "Sport"]),
    ("<body><nav><ul><li><a href=a>Home</a><li><a href=b>Shop</a></ul></nav><main><article><header><h2>How bread rises</h2></header><p>Yeast turns sugar into gas, and the gas is caught by the dough, which swells until it is baked.</p><ul><li>Use warm water, never hot.</li><li>Let the dough rest for an hour.</li></ul></article><aside><h3>Related</h3><ul><li><a href=c>Ten cakes</a></li></ul></aside></main><section class=comments><p>Great recipe, thanks a lot!</p></section></body>",
     ["Yeast turns sugar into gas", "Let the dough rest"], ["Shop", "Ten cakes", "Great recipe"]),
    ("<div class=cookie-banner><p>We use cookies to improve this site. By staying you agree to them.</p><button>OK</button></div><div class=post><h1>A walk in the hills</h1><p>We left the village before dawn, when the air was cold and the path was hard with frost.</p><blockquote>Take a second coat, said the old man.</blockquote><p>He was right, as we found at the top.</p></div><form class=newsletter><p>Subscribe to our newsletter</p><input name=e></form>",
     ["We left the village before dawn", "Take a second coat", "He was right"], ["cookies", "Subscribe"]),
]


def test_pages_made_by_hand(spark):
    rows = [(i, "u", html) for i, (html, _, _) in enumerate(PAGES)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame([*rows, *rows], "page_id long, url string, html string")).collect()}
    for i, (_, kept, gone) in enumerate(PAGES):
        assert all(k in got[i] for k in kept) and not any(g in got[i] for g in gone), (i, got[i])


def test_numerals_are_no_letters(spark):
    assert words_of("a²b Ⅷ ½ x9y") == ["a", "b", "x", "y"] and words_of("² ½ Ⅷ ٣ ㊄") == []
    rows = [(i, "some plain english words here", "en") for i in range(9)] + [(20, "² ½ Ⅷ", None), (21, "x²" * 40_000, None), (21, None, None), (22, "w" * 300_000 + " ²", None)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id >= 20} == {(20, "und"), (21, "en"), (21, "und"), (22, "en")}


def test_one_id_for_many_rows_is_one_text_of_the_sample(spark):
    rows = [(2, f"ein satz mit worten {i}", "de") for i in range(500)] + [(i, "an english sentence", "en") for i in range(30)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts_each=5).collect()
    assert len(got) == 530 and {r.lang_pred for r in got} <= {"de", "en"}


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for n, k, penalty in itertools.product((1, 2, 5, 6), (1, 2, 3), (0.0, 0.7, 4.0)):
        e = rng.normal(size=(n, k)).astype(np.float32)
        got = viterbi(e, np.array([n]), penalty)
        score = lambda path: sum(e[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        assert abs(score(got) - max(map(score, itertools.product(range(k), repeat=n)))) < 1e-4
    sizes = np.array([3, 0, 7, 1])
    e = rng.normal(size=(11, 3)).astype(np.float32)
    apart = np.concatenate([viterbi(e[a : a + n], np.array([n]), 1.0) for a, n in zip((0, 3, 3, 10), sizes)])
    assert (viterbi(e, sizes, 1.0) == apart).all()


def test_models_without_texts():
    assert Model({}).languages == [] and Model({"en": [""]}).languages == ["en"]


def test_hashes_that_collide_remove_nothing(monkeypatch):
    """Windows whose hashes agree by chance go on as runs; only equal words are settled in the scan."""
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words + words[10:40])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5], pa.int64()), "text": pa.array([text])})
    real = substring_dedup.repeated_inside

    def lies(hashes, owner):
        out = real(hashes, owner)
        out[20:25] = np.arange(5)  # says that other windows stand there
        return out

    monkeypatch.setattr(substring_dedup, "repeated_inside", lies)
    rows = [tuple(c.to_pylist()[i] for c in b.columns) for b in substring_dedup._scan(20, 6)([batch]) for i in range(b.num_rows)]
    inside = [(lo, n) for _, _, lo, n, kind in rows if kind == substring_dedup.INSIDE]
    assert sum(n for _, n in inside) == 11 and all(60 <= lo <= 70 for lo, _ in inside)
    runs = {lo + k for _, _, lo, n, kind in rows if kind in (substring_dedup.RUN, substring_dedup.KNOWN) for k in range(n)}
    assert runs == set(range(60))


def test_very_long_runs(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=200_000))
    uuids = "-".join("0e37df36-f698-11e6-8dd4-cb9ced3df976" for _ in range(3000))
    plain = "/".join(["documents", "archive", "project", "report"] * 5000)
    rows = [(1, long), (2, uuids), (3, plain), (4, "a" * 300_000), (5, " ".join('token="abcdef1"' for _ in range(20_000)))]
    got = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1] if s.kind == "random"] == [("random", 0, 200_000)]
    assert not got[2] and not got[3] and not [s for s in got[4] if s.kind == "random"] and len(got[5]) == 20_000


def test_plain_prose_has_no_random_spans(spark):
    words = "international government administration understanding responsibility straightforward Massachusetts extraordinary environmental representatives photographers acknowledgement".split()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words, k=40)) + f" see /{rng.choice(words)}/{rng.choice(words)}_{rng.choice(words)}.html, ISBN 978-3-16-148410-0, {rng.choice(words).upper()}") for i in range(200)]
    assert find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.tiktoken")).where("size(spans) > 0").count() == 0


def test_repeated_and_wide_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=200)]) for i in range(300)]
    rows += [(100, rows[3][1]), (7, rows[5][1])]  # a query's id twice, a candidate's id twice
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0", part_rows=100, query_rows=3).collect()
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    want: dict[int, list] = {}
    for q, x in whole:
        if q % 100 == 0:
            want.setdefault(q, []).extend((-int(x @ v), i) for i, v in whole if i != q)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == {(q, k + 1, i, -s) for q, pairs in want.items() for k, (s, i) in enumerate(sorted(pairs)[:10])}


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    bias, rules = quality.fit_rules(x, y)
    assert rules
    total = np.full(len(x), bias)
    for weight, path in rules:
        total += weight * np.logical_and.reduce([(x[:, f] <= c) == below for f, c, below in path])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [r[0] for r in df.coalesce(1).select(quality.compiled(bias, rules)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((np.array(got) >= 0.5) == (y == 1)).mean() > 0.95


def test_quality_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.5, 1)] * 40 + [(2, None, 0.1, 0)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(1, 0)] * 30 + [(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == 41


def test_index_of_fingerprints_selects():
    """Of unrelated items fewer than one in a hundred pass the index; all within the radius do."""
    passed = sum(len(_probes(bits)) / 2**bits for bits in BLOCK_BITS)
    assert passed < 0.01 and sum(BLOCK_BITS) == 64
    rng = random.Random(4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), len(BLOCK_BITS) * (BLOCK_RADIUS + 1) - 1):
            b ^= 1 << bit
        at, near = 0, False
        for bits in BLOCK_BITS:
            near |= ((a ^ b) >> at & ((1 << bits) - 1)).bit_count() <= BLOCK_RADIUS
            at += bits
        assert near


def test_steps_can_be_dropped(spark):
    step = staged(spark.range(5))
    assert step.count() == 5
    drop_staged(spark)
    with pytest.raises(Exception):
        step.where(F.col("id") > 1).collect()


def test_a_large_worker_forgets():
    held = cached("something", lambda: [0])
    assert list(at_end(iter([1, 2]), most_mb=1e9)) == [1, 2] and cached("something", lambda: [1]) is held
    assert held_mb() > 0 and list(at_end(iter([3]), most_mb=1e-9)) == [3]
    assert cached("something", lambda: [1]) == [1]
