"""HTML extraction against a plain reading of the test pages, and hand-made pages."""

import re
from html import unescape

import pytest

from quern.llm import html_text
from quern.llm.html_text import extract


def plain(html):
    """These test pages hold their article in one article element."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", body)
    return " ".join(filter(None, (" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_corpus(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages, ["page_id"]).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}


P = "<p>A sentence of the article, with commas, and enough length to count as one.</p>"
T = "A sentence of the article, with commas, and enough length to count as one."


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<html><body><p>One.</p><p>Two&nbsp;&amp; three&hellip;</p>", "One. Two & three…"),
        (f"<body><header><h1>Site</h1></header><div id='wrap'><div class='content'><h1>Title</h1>{P}{P}</div><div class='sidebar'><p>Side, side, side, side</p></div></div><footer>f</footer>", f"Title {T} {T}"),
        (f"<body><article><header><h1>T</h1></header>{P}<aside>x, y, z</aside><div class='ad'>Buy</div><form><p>Name, please</p></form></article><section id='comments'><p>{T * 9}</p></section>", f"T {T}"),
        (f"<div class='cookie-notice'><p>{T}{T}{T}</p></div><main class='no-sidebar'>{P}<ul><li>one<li>two</ul></main>", f"{T} one two"),
        (f"<div><nav><a href=x>a</a><a>b</a></nav></div><div>{P}<blockquote>q</blockquote></div>", f"{T} q"),
        (f"<article><p>un<b>bro</b>ken<br>x<p>next<!-- <p>no</p> --><script>'</p>' < 3</script></article>", "unbroken x next"),
        ("<article><h1>T &am</h1><p>a &lt;b&gt; &#233;&#x41; &copy c</p></article>", "T &am a <b> éA © c"),
        (f"<body><div><div class='post-body'>{P}{P}</div><div class='post-comments'>{P}{P}{P}</div></div>", f"{T} {T}"),
        (f"<article>{P}</article><article>{P}</article>", f"{T} {T}"),
        (f"<ARTICLE CLASS=x>{P}<P STYLE='display:none'>h</P><p hidden>h</p><template><p>h</p></template></ARTICLE>", T),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", "a b c x y"),
        (f"<article class='post with-comments comment-enabled'>{P}</article><article class='comment'>{P}</article><article class='reader-comment'>{P}</article>", T),
        (f"<div class='entry-header'><h1>Head</h1></div><div class='story'>{P}{P}</div><div class='share'><p>Share, share</p></div>", f"{T} {T}"),
        ("<p>open <a href='un\"closed>x</a> end", "open x end"),
    ],
)
def test_pages(html, want):
    assert extract(html) == want


def test_deep_and_long_pages():
    assert extract("<div>" * 50_000 + P) == T
    assert len(extract("<article>" + P * 20_000 + "</article>")) == (len(T) + 1) * 20_000 - 1
    assert extract("<" * 20_000) == "<" * 20_000


def test_edges(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "t", 1), (None, "u", "<p>x", None, None), (1, None, None, "t", 1)]
    got = html_text.extract_pages(spark.createDataFrame(rows, schema), ["page_id", "url"]).collect()
    assert sorted(r.text for r in got) == ["", "", "x"]
    assert html_text.extract_pages(spark.createDataFrame([], schema), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<article>{P}<p class='notice-board'>The board met.</p><p class='form-of-art'>A form.</p><p>Some <span class='header-text'>words</span> here.</p>{P}</article>", f"{T} The board met. A form. Some words here. {T}"),
        (f"<article>{P}{P}</article><article><h2>Other</h2><p>Read more…</p></article>", f"{T} {T}"),
        (f"<main><article>{P}{P}{P}</article><article><h2>Other</h2><p>Read more…</p></article></main>", f"{T} {T} {T}"),
        (f"<main><article>{P}</article><article>{P}</article></main>", f"{T} {T}"),
        (f"<article>{P}<div class='notice'><p>We use cookies, and more, and more.</p></div><div class='reader-comments'>{P * 9}</div><div class='ad-slot-2'>Buy, buy</div>{P}</article>", f"{T} {T}"),
        (f"<div class='sidebar-layout'><div>{P}{P}</div></div><div class='sidebar'>{P}</div>", f"{T} {T}"),
        (f"<div id='ad'><div>{P * 3}</div></div>", f"{T} {T} {T}"),
        (f"<div class='page'><div class='x1'>{P}{P}</div><div class='x2'>{P}{P}</div><div class='x3'><a href='#'>one, two, three, four</a></div></div>", f"{T} {T} {T} {T}"),
        (f"<table><tr><td><a href=x>menu, menu</a></td><td>{P}{P}</td></tr></table>", f"{T} {T}"),
        ("<article><div class='ad'><p>only this</p></div></article>", ""),
        (f"<article><span class='ad'>Buy</span>{P}<div class='header'><h2>Sub</h2></div>{P}</article>", f"{T} Sub {T}"),
    ],
)
def test_names_discount_and_scores_decide(html, want):
    assert extract(html) == want


def plain_scores(nodes):
    """Points of every paragraph carried up one ancestor at a time."""
    score = {id(n): 0.0 for n in nodes}
    for n in nodes:
        share, up = 1.0, n
        while up is not None:
            score[id(up)] += n.own * share
            share *= up.factor * (1 if up.tag in html_text.PARAGRAPHS else 0.5)
            up = up.parent
    return score


def test_points_against_a_walk_up_from_every_paragraph(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for html in [*pages, f"<div><div class='notice-x'><section>{P}<ul><li>a, b<li>c</ul></section>{P}</div><td>{P}</div>"]:
        nodes = html_text._walk(html_text.tree(html))
        html_text._give_points(nodes)
        want = plain_scores(nodes)
        assert all(abs(n.score - want[id(n)]) < 1e-9 for n in nodes) and any(n.score for n in nodes)


@pytest.mark.parametrize("page", ['<a href="x' * 200_000, "<div>" * 5000 + "</p>" * 400_000, "<p><table>" + "<div>" * 5000 + "</p>" * 400_000, "<b hidden>" * 5000 + "</i>" * 400_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 6
