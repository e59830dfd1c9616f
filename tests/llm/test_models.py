"""Quality classifier, language models, HTML extraction, pipeline."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigrid.llm import html_text, language_model, quality, queries
from evigrid.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_fold(docs, rows):
    got = sorted((str(r[0]), r[1]) for r in docs.select("doc_id", quality.held_out()).collect())
    assert got == sorted((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = queries.QUERIES["op4_quality_classifier"](spark, SF)
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert scored.count() == docs.count()


def test_scores_are_defined(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (71, 0, None), (None, 1, 0), (72, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    empty = {r.score for r in scored if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    unlabelled = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, unlabelled).collect()} == {0.5}
    kept = quality.keep_good(docs, unlabelled)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality.score(no_docs, model).count() == 0


def test_language_model_prefers_its_target(make_docs, spark):
    rng = random.Random(1)
    own, other = ["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]
    rows = [(i, " ".join(rng.choice(own if i % 2 else other) for _ in range(50))) for i in range(40)]
    rows += [(100, None), (101, "!?"), (102, rows[1][1]), (None, rows[3][1])]
    docs = make_docs(rows)
    marked = language_model.marked(docs, spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id bigint"))
    models = language_model.fit(marked, marked["is_target"])
    scored = {r.doc_id: r for r in language_model.score(marked, models, marked["is_target"]).collect()}
    assert len(scored) == 44
    assert all(scored[i].score > scored[j].score for i in range(1, 40, 2) for j in range(0, 40, 2))
    assert scored[100].score == 0.0 and scored[100].target_loss is None and scored[101].n_tokens == 0
    # counts are those of a plain count
    word, pair, before = language_model.tokens(rows[1][1].encode())
    total = sum(len((t or "").split()) for _, t in rows if t and t != "!?")
    assert models.background[: language_model.WORDS].sum() == total + 42
    assert language_model.own_counts(word, pair, before)[0].sum() >= len(word)


def test_cross_entropy_difference_counts_every_word_and_pair(spark):
    """Losses of the query from exact counts; hashed into a fixed number of buckets, pairs of sf0.01 collide."""
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    labels = table(spark, SF, "labels").where("quality = 1 and toxic = 0").select("doc_id").collect()
    target = {r.doc_id for r in labels}
    found = {r.doc_id: language_model.words((r.text or "").encode()) for r in docs}
    assert len(found) == len(docs)
    counts = []
    for ids in (set(found), target & set(found)):
        pairs = collections.Counter(p for i in ids for p in itertools.pairwise([None, *found[i]]))
        words = collections.Counter(w for i in ids if found[i] for w in [None, *found[i]])
        counts.append((pairs, words, sum(words.values())))
    size = len(counts[0][1]) - 1

    def loss(model, text, left_out):
        pairs, words, total = model
        own = collections.Counter(itertools.pairwise([None, *text])), collections.Counter([None, *text])
        pair, word, less = (own[0], own[1], len(text) + 1) if left_out else ({}, {}, 0)
        out = 0.0
        for before, w in itertools.pairwise([None, *text]):
            context = words[before] - word.get(before, 0)
            after = min((pairs[before, w] - pair.get((before, w), 0)) / context, 1.0) if context > 0 else 0.0
            single = (words[w] - word.get(w, 0)) / (total - less)
            uniform = (1 - language_model.PAIR_WEIGHT - language_model.WORD_WEIGHT) / size
            out -= math.log(language_model.PAIR_WEIGHT * after + language_model.WORD_WEIGHT * single + uniform)
        return out / len(text)

    got = queries.QUERIES["op5_cross_entropy_difference"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        text = found[r.doc_id]
        assert r.n_tokens == len(text)
        if text:
            assert r.background_loss == pytest.approx(loss(counts[0], text, True))
            assert r.target_loss == pytest.approx(loss(counts[1], text, r.doc_id in target))
            assert r.score == pytest.approx(r.background_loss - r.target_loss)


def test_differences_of_awkward_texts(spark, docs, rows, no_docs):
    marked = language_model.marked(docs, spark.createDataFrame([(10,), (50,)], "doc_id bigint"))
    scored = language_model.differences(marked, marked["is_target"]).collect()
    assert len(scored) == len(rows)
    assert all(r.score == 0.0 and r.target_loss is None for r in scored if not r.n_tokens)
    assert {1, 2, 3, 5} <= {r.doc_id for r in scored if not r.n_tokens}
    assert language_model.differences(no_docs, F.lit(None).cast("boolean")).count() == 0
    assert language_model.differences(docs, F.lit(False)).count() == len(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body>
<header><h2>Site name</h2><a href=/>home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies, all of them, and more.</div>
<div id=page><div class="content"><h1>Title &amp; more</h1><p>First   paragraph, with commas, and
text&nbsp;that is long enough to count.<p>Second one<br>goes <b>on, and <i>on</b></i> here, &lt;really&gt;.
<ul><li>point one, said so<li>point two</ul><script>if (a < b) { document.write("</p>") }</script><!-- gone -->
<table><tr><td>cell a<td>cell b</table><ul class="x"><li><a href=1>more one</a><li><a href=2>more two</a></ul></div>
<aside>Side text, with, many, commas.</aside></div>
<section class="comments"><h3>Comments</h3><p>I liked this, very much, honestly, a lot, yes, indeed, and more of the same here.</p></section>
<form><p>Sign up, please</p><input></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph, with commas, and text that is long enough to count.", "Second one goes on, and on here, <really>.",
        "point one, said so", "point two", "cell a", "cell b",
    ]


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b & c", "<p>x" * 5000, "<div>" * 3000 + "deep", "</p></div>", "<!--", "<a href='", "<a " * 20_000])
def test_broken_pages(page):
    text = html_text.main_text(page)
    assert "<p>" not in text and "\n\n\n" not in text
    assert ("deep" in text) == ("deep" in page)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", PAGE, "t")], "page_id int, url string, html string, text string")
    out = html_text.extract(pages).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out)[:2] == [0, 0]
    assert html_text.extract(pages.limit(0)).count() == 0
    article = table(spark, SF, "pages").where("html like '%<article>%'").limit(50)
    texts = {r.page_id: r.text for r in html_text.extract(article).collect()}
    assert all(texts[r.page_id] and "function" not in texts[r.page_id] for r in article.collect())


def test_pipeline_on_awkward_documents(spark, make_docs, rows, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = make_docs(rows).select(*columns)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/stage_{name}"
        stage(spark, step, str(tmp_path)).write.parquet(path)
        step = spark.read.parquet(path)
        sizes.append(step.count())
        if name != "tokens":
            assert step.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == sizes[-1]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_without_documents(spark, make_docs, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    make_docs([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LONG = "A paragraph of the article, with commas, and enough words to be told from a menu or a notice by its length alone."


@pytest.mark.parametrize("name", ["post has-sidebar", "post comments-open", "hentry", "sidebar", "layout no-sidebar widget"])
def test_an_article_is_not_dropped_for_its_class(name):
    page = f"<body><nav><a href=a>A</a></nav><article class='{name}'><p>{LONG}</p><p>{LONG}</p></article><footer>F</footer></body>"
    assert html_text.main_text(page) == f"{LONG}\n\n{LONG}"
    inner = f"<body><div class='{name}'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.main_text(inner) == f"T\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("box", [
    "<p class='advert'>Buy now</p>", "<div class='ad-slot-2'>Buy now</div>", "<div class='cookie-notice'><p>We use cookies.</p></div>",
    "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul>", "<h3>Related posts</h3><ul class='related-posts'><li><a href=a>x</a></ul>",
    "<article class='comment'><p>Nice article, thank you for it.</p></article>", "<section id='comments'><p>First!</p></section>",
])
def test_boxes_inside_an_article_go(box):
    page = f"<body><main><article><h1>T</h1><p>{LONG}</p>{box}<p>{LONG}</p></article></main></body>"
    assert html_text.main_text(page).replace("Related posts\n\n", "") == f"T\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("part, text", [
    ("<section><p>Short.</p></section>", "Short."), ("<div>Also short</div>", "Also short"),
    ("<section><h2>Points</h2><ul><li>one<li>two</ul></section>", "Points\n\none\n\ntwo"),
    ("<div class='warning'><p>Mind the step.</p></div>", "Mind the step."), ("<div class='social-history'>1848</div>", "1848"),
    ("<h2>References</h2><ol><li><a href=a>Doe 2001</a><li><a href=b>Roe 2002</a></ol>", "References\n\nDoe 2001\n\nRoe 2002"),
    ("<p>See also:</p><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>", "See also:\n\nOne\n\nTwo"),
    ("<h2 id='related'>Kin</h2>", "Kin"),
])
def test_parts_of_an_article_stay(part, text):
    page = f"<body><div id='sidebar'><p>Side.</p></div><article><section><p>{LONG}</p><p>{LONG}</p></section>{part}</article></body>"
    assert html_text.main_text(page) == f"{LONG}\n\n{LONG}\n\n{text}"
