"""Toxicity, quality and main text: accuracy on held-out rows, restored words, awkward pages."""

import time

import numpy as np
import pandas as pd
import pytest

from shelfgrid.llm import quality as quality_model
from shelfgrid.llm.html_text import extract_text, main_text
from shelfgrid.llm.q_labels import quality, toxicity
from shelfgrid.llm.quality import score_quality
from shelfgrid.llm.toxicity import CharModel, clear_words, score_toxicity

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string"


@pytest.mark.parametrize(("build", "label", "least"), [(toxicity, "toxic", 0.95), (quality, "quality", 0.98)])
def test_held_out_accuracy(spark, build, label, least):
    out = build(spark, DATA).where("held_out").toPandas().merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    assert (out.predicted == out[label]).mean() > least


def test_restored_words():
    counts = {}
    for word in ["idiot"] * 50 + ["stupid"] * 50 + ["hello", "world", "good"] * 20:
        padded = f"^^{word}$"
        for i in range(len(padded) - 2):
            counts[padded[i:i + 3]] = counts.get(padded[i:i + 3], 0) + 1
    model = CharModel(counts)
    for written, clear in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("s t u p i d", "stupid"), ("$tup1d!", "stupid"), ("i.d.i.o.t", "idiot")):
        assert clear in clear_words(f"hello {written} good", model, {}), written
    assert clear_words("hello world", model, {}) == {"hello", "world"}
    assert clear_words("", model, {}) == set()


def test_spaced_and_long_words_are_restored():
    counts = {}
    for word in ["idiot"] * 50 + ["stupid"] * 50 + ["ass", "hello", "good", "person", "you", "are"] * 20:
        padded = f"^^{word}$"
        for i in range(len(padded) - 2):
            counts[padded[i:i + 3]] = counts.get(padded[i:i + 3], 0) + 1
    model = CharModel(counts)
    cases = [
        ("you are a s t u p i d person", "stupid"), ("s t u p i d i d i o t", "stupid idiot"), ("s t u p i d  i d i o t", "stupid idiot"),
        ("$ t u p 1 d", "stupid"), ("s t u p ! d", "stupid"), ("i d ! o t", "idiot"), ("you a s s", "ass"), ("stupid-idiot", "stupid idiot"),
        ("-".join("stupid").replace("-", "-" * 8), "stupid"), ("st" + "u" * 250 + "pid", "stupid"), ("s t u p i d i d i o t " * 30, "stupid idiot"),
    ]
    for written, clear in cases:
        assert set(clear.split()) <= clear_words(f"hello {written} good", model, {}), written
    assert "1" in clear_words("1 2 3", model, {}) and clear_words("a", model, {}) == {"a"}
    assert len(clear_words("s" + "-" * 100_000 + "t " + "a " * 50_000, model, {})) < 20


def test_scores_of_awkward_rows(spark):
    bad = [(f"you are a nasty person number {i}", 1) for i in range(40)] + [(f"a fine day with number {i}", 0) for i in range(80)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "NASTY nasty n4sty", "x"), (4, "fine day", "x"), (4, "fine day", "x"), (5, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    toxic = spark.createDataFrame(bad, "text string, toxic int")
    out = sorted((r["doc_id"], r["predicted"]) for r in score_toxicity(docs, toxic).collect())
    assert out == [(1, 0), (2, 0), (3, 1), (4, 0), (4, 0), (5, 0)]
    assert score_toxicity(docs.limit(0), toxic).count() == 0
    assert {round(r["score"], 6) for r in score_toxicity(docs, toxic.limit(0)).collect()} == {0.5}
    good = spark.createDataFrame([(f"Plain text, number {i}.", 1) for i in range(30)] + [("### $$$", 0)] * 10, "text string, quality int")
    scores = [r["score"] for r in score_quality(docs, good).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert score_quality(docs.limit(0), good).count() == 0
    assert {r["score"] for r in score_quality(docs, good.limit(0)).collect()} == {0.5}


def test_copies_are_sampled_one_by_one(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality_model, "fit_nonnegative", lambda p, u, prior: taken.extend((p, u)) or (np.zeros(quality_model.WIDTH), 0.0))
    rows = [(i, "the same text, in a third of all rows" if i % 3 == 0 else f"Text {i} of its own.", 1) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert score_quality(frame.drop("quality"), frame, most=300).count() == 3000
    for sample in taken:
        shares = (sample == quality_model.features(rows[0][1])).all(axis=1).mean()
        assert len(sample) == 300 and 0.2 < shares < 0.47


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy, buy, buy this thing now, it is so very good.</div>
<article><h1>The  title</h1><p><b>First, a paragraph &amp; with some words in it,<br>and more.
<p>Second, a paragraph of about the same length, with commas.</p><div class="comments"><p>I, too, like this article very much.</p></div>
<form><input><label>Mail</label></form><ul><li>One item</li><li>Two &lt;items&gt;</li></ul></article>
<aside>Side</aside><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "The title", "First, a paragraph & with some words in it, and more.", "Second, a paragraph of about the same length, with commas.",
        "One item", "Two <items>",
    ]
    for html in (None, "", "<", "<p", "</div></p>", "<script>x", "<nav><p>menu</p></nav>", "<!-- open"):
        assert main_text(html) in ("", "<", "<p"), html
    assert main_text("just text, no tags at all") == "just text, no tags at all"
    assert main_text("<div>" * 5000 + "<p>deep, but here" + "</div>" * 5000) == "deep, but here"


@pytest.mark.parametrize("wrapper", [
    "div class='content has-sidebar'", "div class='post with-comments'", "div class='page no-header'", "div class='wrap fixed-nav'",
    "div class='entry share'", "section class='search-result'", "div id=widget-17", "div class='sidebar'",
])
def test_wrappers_keep_their_article(wrapper):
    text = "A paragraph of the article, with commas, and enough words to count as one."
    inner = f"<p>{text}</p><p title='a hidden gem'>{text}</p><div class='comments'><p>I, too, like this very much.</p></div><div class='cookie-banner'>We use cookies, many.</div>"
    tag = wrapper.split()[0]
    assert main_text(f"<body><{wrapper}><div>{inner}</div></{tag}></body>") == f"{text}\n{text}"
    if "sidebar'" not in wrapper or "has" in wrapper:
        assert main_text(f"<body><div>Footer line of the page</div><{wrapper}><div>{inner}</div></{tag}></body>") == f"{text}\n{text}"


def test_quotes_only_quote_behind_an_equals_sign():
    assert main_text('<p class=x">First paragraph, with words.</p><p class="y">Second paragraph, with words.</p>') == "First paragraph, with words.\nSecond paragraph, with words."
    assert main_text("<p data-x=it's>One, two and three.</p><p>It's four, five and six.</p>") == "One, two and three.\nIt's four, five and six."
    assert main_text("<div><a title='a > b'>Link</a> and text, of some length.</div>") == "Link and text, of some length."
    assert main_text('<p class="never closed>Text, all the same, is read.</p>') == "Text, all the same, is read."


@pytest.mark.parametrize("html", [
    "<a " * 350_000, '<a "' * 250_000, '<a x="' * 200_000, "<div>x" * 50_000, "<b>x" * 50_000, "<!--" * 250_000, "<!" * 500_000 + ">", "</x>" * 250_000,
    "<b>" + "<div>" * 50_000 + "</b>" * 50_000, "<p><" * 250_000, "&amp" * 250_000,
])
def test_broken_pages_take_linear_time(html):
    started = time.time()
    main_text(html)
    assert time.time() - started < 5


def test_hidden_is_an_attribute():
    for attributes in ("hidden", "hidden=''", "aria-hidden='true'", "style='color: red; display: none'"):
        assert main_text(f"<div><p>Shown, with some more words in it.</p><p {attributes}>Not shown, with some more words.</p></div>") == "Shown, with some more words in it."


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, PAGE, "t"), (2, PAGE, "t")], "page_id long, html string, text string")
    out = extract_text(pages).collect()
    assert sorted((r["page_id"], r["n_chars"] > 0) for r in out) == [(1, False), (2, True), (2, True)]
    assert all(len(r["text"]) == r["n_chars"] for r in out)
    assert extract_text(pages.limit(0)).count() == 0
