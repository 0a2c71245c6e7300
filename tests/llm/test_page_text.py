"""Main text of pages: the shared pages, layouts not trained on, exact messages, and broken markup."""

import html as html_module
import itertools
import re
import time

import numpy as np
import pytest

from tallyveil.llm import page_text
from tallyveil.llm.page_seeds import seed_pages

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return page_text.fit([])


def article_of(page):
    """The article of a shared page, by its known template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
    return " ".join(b for b in (" ".join(html_module.unescape(b).split()) for b in blocks) if b)


def test_query_finds_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = page_text.op6_main_text(spark, FOLDER).collect()
    assert len(got) == len(pages)
    assert [r.page_id for r in got if r.text != article_of(pages[r.page_id].html)] == []
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_layouts_not_trained_on(model):
    pages = seed_pages(400)[160:]
    right = 0
    for page, got in zip(pages, model.texts(pages)):
        nodes = page_text.read_nodes(page)
        right += got == " ".join(n[4] for n, y in zip(nodes, page_text.marked_labels(nodes)) if n[4] is not None and y == page_text.ARTICLE)
    assert right / len(pages) > 0.93


def test_messages_give_exact_marginals(model):
    nodes = page_text.read_nodes("<div class='x'><p>Some words, here.</p><ul><li><a href='/'>Go</a></li></ul>tail</div>")
    forest = page_text.Forest([nodes], model.index, model.kinds)
    unary = np.add.reduceat(model.seen[forest.seen], forest.starts, axis=0)
    unary[forest.text, page_text.MIXED] = -1e3
    total = np.zeros_like(unary)
    for labels in itertools.product(range(3), repeat=len(nodes)):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(model.ties[forest.kind[i], labels[p], labels[i]] for i, p in enumerate(forest.parent) if p >= 0)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert np.allclose(model.marginals([nodes]), total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_markup_and_references(model):
    page = (
        "<!-- <p>no</p> --><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p title='a>b'>One&nbsp;\n two<b>th</b>ree &lt;x&gt; &eacute; &copy\n<p>Four<br>five"
        "<script>var t = '</p><p>bad</p>';</script></i> six</article><style>p{}</style><footer>end &middot;</footer>"
    )
    assert model.texts([page]) == ["A & B One twothree <x> é © Four five six"]
    odd = [None, "", "<", "<p", "text <a", "<p class=\"x>broken</p>", "</div></p>stray", "<script>never closed", "<p>" * 3000, "<div" + " a" * 2000 + ">x</div>", "\x00<p>\ud800".encode("utf-8", "replace").decode()]
    assert len(model.texts([o or "" for o in odd])) == len(odd)


def test_rows_and_empty_table(spark, model):
    article = "<article><h1>Title of it</h1><p>" + "The river rose again, and the fields were under water. " * 5 + "</p></article>"
    rows = [(1, "u", article, 5), (1, "u", article, 5), (2, None, None, 5), (None, "v", "", 5), (3, "w", "<nav><a href=x>Home</a></nav>", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = page_text.main_text(df, model).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False), (3, False)]
    assert page_text.main_text(df.limit(0), page_text.train(df.limit(0))).collect() == []


def texts_of(page):
    return [n[4] for n in page_text.read_nodes(page) if n[4] is not None]


@pytest.mark.parametrize("page, wanted", [
    ("<p>energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> as said</p>", ["energy is E=mc as said"]),
    ("<p>one <svg><path d='M0'/>LEAK<svg>inner</svg>LEAK</svg> two</p>", ["one two"]),
    ("<p>one <svg><path/>gone<p>two</p><p>three</p>", ["one", "two", "three"]),
    ("<p>one</p><template><p>no</p><template>no</template>no</template><p>two</p>", ["one", "two"]),
    ("<p>one</p><svg/><p>two</p><math/><p>three", ["one", "two", "three"]),
    ("<p>one</p><template><p>inert", ["one"]), ("<title>lost <p>lost", []), ("<script>if (a<b) '</p>'</script><p>one", ["one"]),
    ("a < b <p title='x>y'>c <!-- no > --> d <!doctype x> e <? f > g <!-- open", ["a < b", "c d e g"]), ("one <b", ["one <b"]), ("one <p title='open> two <p>three", ["one", "two", "three"]),
])
def test_foreign_and_open_markup(page, wanted):
    assert texts_of(page) == wanted


@pytest.mark.parametrize("page", [
    "<a" * 300_000, "<a" * 300_000 + ">", "<p " * 100_000 + "'", "<p a=\">" * 100_001, "<p a=\">\" " * 100_000, "<!--" * 200_000, "<!" * 300_000, "<" * 500_000, "</p" * 300_000, "<div>" * 60_000 + "</p>" * 60_000,
    "<svg>" * 100_000, "<b>x</b>" * 100_000, " " * 1_000_000, "語" * 500_000, "<p>" + "a" * 1_000_000, "&" * 500_000,
])
def test_long_pages_end(page):
    start = time.monotonic()
    nodes = page_text.read_nodes(page)
    assert time.monotonic() - start < 20
    if len(nodes) > 2:
        depth = [0] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            depth[i] = depth[n[0]] + 1
        assert max(depth) <= page_text.DEEPEST + 1


def test_deep_pages_keep_their_text(model):
    page = "<div>" * 3_000 + "<p>Deep words, kept whole.</p>" + "</div>" * 3_000 + "<p>After.</p>"
    assert texts_of(page) == ["Deep words, kept whole.", "After."]
    assert len(model.texts([page])) == 1
