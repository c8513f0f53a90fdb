"""Main texts of pages: planted articles, odd markup, the scan against every run."""

from __future__ import annotations

import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import html_regions as regions
from rankloom.llm import queries
from tests.conftest import SMALL

PRIOR = regions.Weights()
SCHEMA = "page_id long, url string, html string"
NOISE = [
    '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">All our news</a></li></ul></nav>',
    '<div class="cookie-notice">We use cookies on this site, please agree to all of them.</div>',
    '<header><h1>The daily site</h1><a href="/">start</a></header>',
    '<aside><h2>Most read</h2><p>Ten things that nobody knew about cheese and bread.</p></aside>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go on</button></form>',
    '<script>var t = "</p><article>" + (1 < 2);</script><style>p > b {margin: 0}</style>',
    '<div class="ad-banner top"><p>Buy two of these and get a third one free today only!</p></div>',
    '<div id="sidebar-left"><p>Follow us on every network there is, we are nice.</p></div>',
    '<section id="comments"><h3>Two comments</h3><article class="comment"><p>I liked it a lot, thanks!</p></article></section>',
    '<footer><p>&copy; The daily site, all rights reserved by us and others.</p></footer>',
    '<!-- an advert <p>never seen</p> -->', '<noscript>Please turn scripts on.</noscript>',
]


def body(rng):
    """Blocks of an article as markup, and their text."""
    words = "river bank under old bridge where three boats wait for rain & wind <soon> says “Ann” naïvely".split()
    blocks, texts = [f"<h1>Report {rng.randrange(99)}</h1>"], None
    texts = [re.sub("<.*?>", "", blocks[0])]
    for _ in range(rng.randrange(3, 9)):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(6, 40)))
        texts.append(text)
        some = html.escape(text).split(" ")
        some[1] = f"<b class='comment'>{some[1]}</b>"
        some[2] = f'<a title="a > b" href="/x">{some[2]}</a>'
        blocks.append(rng.choice(["<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>",
                                  "<div>{}</div>", "<table><tr><td>{}</td><td></td></tr></table>"]).format(
            rng.choice([" ", "\n\t ", "&nbsp;"]).join(some)))
    return blocks, " ".join(texts)


def page(rng, wrap):
    blocks, text = body(rng)
    before, after = rng.sample(NOISE[:3], 2) + NOISE[5:6], [*rng.sample(NOISE, 5), NOISE[8], NOISE[9]]
    inner = "\n".join(blocks[:2]) + rng.choice(NOISE[5:7] + NOISE[10:]) + "".join(blocks[2:])
    return ("<!DOCTYPE html><html><head><title>A title</title></head><body class='has-sidebar no-ads'>"
            + "".join(before) + wrap.format(inner) + "".join(after) + "</body></html>"), text


@pytest.mark.parametrize("wrap", [
    "<article>{}</article>", "<main class='with-menu'>{}</main>", "<div>{}</div>", '<div class="entry-content">{}</div>',
    "<div><section>{}</section></div>", "<form id='aspnet'><article>{}</article></form>", "<nav><ul><article>{}</article>",
])
def test_planted_articles(wrap):
    rng = random.Random(len(wrap))
    for _ in range(60):
        made, text = page(rng, wrap)
        assert regions.main_text(made, PRIOR)[0] == text


@pytest.mark.parametrize("made, text", [
    ("", ""), ("   ", ""), ("<p></p>", ""), ("<p>one", "one"), ("a < b and c > d", "a < b and c > d"),
    ("<p>a<br>b<b>c</b>d <i> e</i></p>f", "a bcd e f"), ("<p>x &amp;lt; &amp &#233; &eacute;&nbsp;&bogus; &am</p>", "x &lt; & é é &bogus; &am"),
    ("<article><h1>Hi</h1></article><div>more words than in the article</div>", "Hi"),
    ("<p>kept</p><script>lost words", "kept"), ("<p>kept words</p><!-- lost words", "kept words"),
    ("<article><p>kept</p><p hidden>lost</p><p>too</p></article>", "kept too"),
    ("<nav>only a menu</nav><footer>and a footer</footer>", ""), ("<title>only a title</title>", ""),
    ("<p>tag cut off <a href='x", "tag cut off"), ("<p>x</ p>y</p>", "xy"), ("<P CLASS=AD>lost</P><P>kept", "kept"),
    ("<article><h2>Related work</h2><p>kept</p></article>", "Related work kept"),
])
def test_odd_pages(made, text):
    assert regions.main_text(made, PRIOR)[0] == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_scan_finds_the_best_run(values):
    start, end, best = regions.best_run(values)
    every = [(sum(values[i:j]), -i, -j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    top = max([s for s, _, _ in every] + [0])
    assert best == top == sum(values[start:end])
    if top > 0:
        assert start == min(-i for s, i, _ in every if s == top) or values[start] > 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["<", ">", "</", "p", "div", "article", "<b>", "</b>", "<p>", "</p>", "<!--", "-->", "<script>", "</script>", "'", '"', "=",
     " ", "word", "&amp;", "<a href=", "</a>", "<nav>", "</nav>", "<form>", "</form>", "<li>", "class='ad'", "/>", "\x00"]), max_size=25))
def test_any_markup_is_read(parts):
    made = "".join(parts)
    text, start, end, _ = regions.main_text(made, PRIOR)
    assert 0 <= start <= end <= len(made)
    assert text == " ".join(text.split())


def test_long_pages_take_time_in_proportion():
    for part in ("<b>", "<!-- x --", "<a title='", "<p>x", "</div", "<div><p>", "=\"<x "):
        regions.main_text(part * 100_000, PRIOR)
    made = "<article>" + "<p>" + "word " * 2_000_000 + "</p></article>"
    assert regions.main_text(made, PRIOR)[0].count("word") == 2_000_000


def marked_text(made):
    """The article by its own mark, another way: tags cut by a pattern."""
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", made)[1]
    blocks = re.split(r"(?i)<(?:/?(?:p|h1)|br)>", inner)
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(filter(None, plain))


def test_query_gives_the_marked_articles(spark):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op11_region_extraction(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        text = marked_text(r["html"])
        assert got[r["page_id"]] == (text, len(text))


def test_unmarked_pages_by_learned_weights(spark):
    """Without the mark's tags, the weights learned from marked pages find the same texts."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = regions.fit(pages, labelled_pages=40)
    assert weights.words and weights.tags
    right = 0
    rows = pages.collect()
    for r in rows:
        made = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        right += regions.main_text(made, weights)[0] == marked_text(r["html"])
    assert right == len(rows)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a b</p>"), (None, "u", "<p>c</p>"), (2, "u", None), (1, None, "<p>a b</p>"), (3, "u", "")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as text", "1 as n_chars", "'y' as draw")
    weights = regions.fit(pages)
    assert not weights.words
    got = sorted(str((r["page_id"], r["url"], r["text"], r["n_chars"])) for r in regions.extract(pages, weights).collect())
    assert got == sorted(map(str, [(1, None, "a b", 3)] * 2 + [(None, "u", "c", 1), (2, "u", "", 0), (3, "u", "", 0)]))
    none = spark.createDataFrame([], SCHEMA)
    assert regions.extract(none, regions.fit(none)).collect() == []


def test_weights_are_shares(spark):
    made = "<body><div>out side</div><article><p>in <a>side</a> now</p></article></body>"
    pages = spark.createDataFrame([(i, "u", made) for i in range(30)], SCHEMA)
    weights = regions.fit(pages, labelled_pages=10)
    assert weights.words["unmarked", "p", ""] == (20.0, 20.0)
    assert weights.words["unmarked", "div", ""] == (0.0, 20.0)
    assert weights.words["inside", "p", "a"] == (10.0, 10.0)
    assert weights.tags["unmarked", "p", ""] == (0.0, 20.0)
    assert weights.tags["beside", "div", ""] == (20.0, 20.0)
    assert weights.word(("unmarked", "div", "")) < weights.word(("unmarked", "section", ""))
