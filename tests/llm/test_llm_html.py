"""Main text against articles whose text is known."""

from __future__ import annotations

import html
import random
import re
import time

import pytest
from llm_samples import prose

from shelfline.llm import htmltext
from shelfline.llm.htmltext import main_text

FOLDER = "/root/testdata/sf0.01"
STORY = [prose(n, 40) + ", " + prose(n + 1, 30) + "." for n in range(0, 10, 2)]


def paragraphs(texts=STORY) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


def plain(page: str) -> str:
    """The article of a page of the test tables, by patterns."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (re.sub(r"</?(b|br)>", " ", x) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<!--.*?-->", "", found, flags=re.S)))
    texts = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in texts if x)


def test_every_page(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    expected = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    rows = htmltext.extract(pages).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (*expected[r.page_id], len(expected[r.page_id][1]))


FURNITURE = [
    '<nav><a href="/">home</a> menu words, and more</nav>', '<div class="ad">Buy this, and that, now, for less.</div>',
    '<aside>aside, text, words.</aside>', '<div id="sidebar"><p>side, bar, text.</p></div>', "<script>var x = '<p>no</p>';</script>",
    "<style>p{margin:0}</style>", '<form><label>mail</label><input name="q"><button>go</button></form>',
    '<div class="cookie-notice">We use cookies, many of them.</div>', '<section class="comments"><p>First, I agree.</p></section>',
    '<div class="CommentList"><p>Second, me too.</p></div>', "<noscript>turn it on</noscript>", "<!-- <p>old text</p> -->",
    '<div role="banner">top, of the page.</div>', "<div hidden><p>not seen, at all.</p></div>", '<p style="display: none">nor this.</p>',
    '<ul class="nav-list"><li><a href="/a">a</a></li></ul>', '<div class="related-posts"><a href="/x">x, y, and z</a></div>',
    '<textarea>draft <p></textarea>', "<select><option>one<option>two</select>", '<svg><title>t</title><text>drawn</text></svg>',
    '<div><a href="/1">one</a> <a href="/2">two</a> <a href="/3">three</a></div>',
]
SHELLS = [
    "<html><head><title>t</title></head><body><header>site, name</header>{furniture}<article><h1>Head &amp; line</h1>{story}</article>"
    "<footer>&copy; all, rights, reserved.</footer></body></html>",
    '<body><div id="page"><div class="header">site</div><div class="post"><h1>Head &amp; line</h1><div class="entry-content">{story}'
    "</div></div>{furniture}<div class='footer'>end, of page.</div>",
    "<main class=content>{furniture}<h1>Head &#38; line</h1>{story}</main>",
    '<table><tr><td class="menu"><a href=/>x</a><td><h1>Head &amp line</h1>{story}{furniture}</table>',
]


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("seed", range(8))
def test_furniture_is_left_out(shell, seed):
    rng = random.Random(seed)
    some = "\n".join(rng.sample(FURNITURE, 8))
    assert main_text(shell.format(furniture=some, story=paragraphs())) == "\n".join(["Head & line", *STORY])


@pytest.mark.parametrize("piece", FURNITURE)
def test_furniture_within_the_article(piece):
    assert main_text(f"<article>{paragraphs(STORY[:2])}{piece}{paragraphs(STORY[2:])}</article>") == "\n".join(STORY)


def test_furniture_alone_has_no_text():
    assert main_text("".join(x for x in FURNITURE[:-1])) == ""
    assert main_text("<nav>a, b.</nav><footer>c, d.</footer>") == ""


def test_blocks():
    page = ("<article><h2>A  b</h2>x <b>y</b>\n z<p>one<br>two&nbsp;three<p>four<ul><li>five<li>six <i>6</i></ul><blockquote>"
            "<p>&lt;p&gt; &eacute;&#x1F600;&notin;</blockquote><pre>a\n  b</pre><table><tr><td>c<td>d</table><p></p><hr>e<div>f</div>g")
    assert main_text(page) == "A b\nx y z\none two three\nfour\nfive\nsix 6\n<p> é😀∉\na b\nc\nd\ne\nf\ng"


@pytest.mark.parametrize("page, text", [
    ("", ""), (" \n ", ""), ("plain, text", "plain, text"), ("a < b & c", "a < b & c"), ("<p title='a > b'>x</p>", "x"), ("<p>x<!-->y", "xy"),
    ("<p>x<!-- y", "x"), ("<p>x <a href='y", "x"), ("<p>x<script>y", "x"), ("<p class=a/>x</div></span>y", "xy"), ("<P>X</P><DIV>Y</DIV>", "X\nY"),
    ("<p>x</p>\x00<p> y</p>", "x\n\x00\ny"), ("<?xml version='1'?><!doctype html><p>x", "x"), ("<p>&amp;lt;", "&lt;"),
    ("<a href=/><p>x</a> y", "x y"), ("<h1>only a heading</h1>", "only a heading"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_sections_of_one_article_stay_together():
    page = f"<body><div id=wrap><article><h1>T</h1><section>{paragraphs(STORY[:3])}</section><section>{paragraphs(STORY[3:])}</section></article>"
    assert main_text(page) == "\n".join(["T", *STORY])
    assert main_text(f'<article class="post has-sidebar no-comments">{paragraphs()}</article>') == "\n".join(STORY)


def test_rows(spark):
    page = f"<article>{paragraphs()}</article>"
    rows = [(1, "u", page, "?"), (1, "u", page, "?"), (2, None, None, "?"), (None, "v", "", "?"), (3, "w", "<p>" + "x, " * 200_000, "?")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = htmltext.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    whole = "\n".join(STORY)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "u", whole, len(whole))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", ("x, " * 200_000)[:-1], 599_999)], key=str)
    assert htmltext.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<div>", "<i hidden>", "<a><div>", "<", "<!--", "<a x='", "&", "<li><ul>", "<p>x", "<td>", "<table>", "<p><button><div>"])
def test_time_follows_length(part):
    def took(n):
        start = time.perf_counter()
        main_text(part * n + "</i></a></p></td>" * n)
        return time.perf_counter() - start

    took(1000)
    assert took(20_000) < 40 * max(took(2000), 0.002)
