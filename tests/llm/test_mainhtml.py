import html
import re
import time

import pytest
from pyspark.sql import functions as F

from quaystone.llm import mainhtml
from quaystone.llm.queries import QUERIES, table


def plain(page):
    """The article of the given tables' pages, by cutting the string."""
    found = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", found[1].replace("<br>", " "))
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts]
    return "\n".join(p for p in parts if p)


def test_query_equals_plain_cut(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op3_html_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "This sentence is long enough to be prose, with a comma, and it goes on for a while so that it scores. "
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Menu item number {i}, with a comma</a></li>' for i in range(30)) + "</ul>"
WANT = f"Title &\n{LONG.strip()}\nSecond x < y.\nitem one\nitem two\n{LONG.strip()}"
ARTICLE = f"<h1>Title &amp;</h1><p>{LONG}</p><p>Second  x &lt;\n y.</p><ul><li>item one<li>item two</ul><p>{LONG}"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{MENU}<article>{ARTICLE}</article></body></html>",
        f"<body><div id=top-menu class='menu'>{MENU}</div><div class=post-content>{ARTICLE}</div><div class='comments'><p>{LONG * 9}</p></div>",
        f"<nav>{MENU}</nav><main><header>{''}</header>{ARTICLE}</main><aside><p>{LONG * 5}</p></aside><footer><p>{LONG * 5}</p></footer>",
        f"<div><div role='navigation'>{MENU}</div><section>{ARTICLE}</section><div class='sidebar widget'><p>{LONG * 5}</div></div>",
        f"<script>var a = '<p>{LONG}</p>';</script><style>p {{}}</style><!-- <p>{LONG}</p> --><div class='cookie-notice'><p>{LONG * 3}</p></div><div>{ARTICLE}</div><form><p>{LONG * 3}</p><textarea>{LONG * 4}</textarea></form>",
        f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table>",
        f"<div style='display:none'><p>{LONG * 9}</p></div><div hidden><p>{LONG * 9}</p></div><article>{ARTICLE}</article>",
    ],
)
def test_layouts(page):
    assert mainhtml.main_text(page) == WANT


def test_edges(spark):
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    rows = [(1, None), (2, ""), (3, "just text &eacute; &#233; &bogus;"), (4, "<p>a<b>b</b> c<i>d</i></p>"), (5, "<script>"), (6, deep), (7, f"<article>{('<p>' + LONG) * 3000}</article>"), (None, "<p>x"), (4, "<p>a<b>b</b> c<i>d</i></p>"), (8, "<<>><p <a</p></div></p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in mainhtml.extract(df, ["page_id", "url"]).collect()}
    assert got[1] == got[2] == got[5] == "" and got[3] == "just text é é &bogus;" and got[4] == "ab cd" and got[None] == "x"
    assert got[6] == LONG.strip() and got[7].count("\n") == 2999
    assert mainhtml.extract(df.limit(0), ["page_id"]).count() == 0


INNER = f"<p>{LONG}</p>" * 6
BODY = "\n".join([LONG.strip()] * 6)
NOTE = "A short note"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>Title</h1><div class=entry><div class=inner>{INNER}</div></div></article>", f"Title\n{BODY}"),
        (f"<article><h1>Title</h1><p>Intro.</p><div><div><div>{INNER}</div></div></div></article>", f"Title\nIntro.\n{BODY}"),
        (f"<main><section><h2>One</h2>{INNER}</section><section><h2>Two</h2><div>{NOTE}</div></section></main>", f"One\n{BODY}\nTwo\n{NOTE}"),
        (f"<body><div>{MENU}</div><section>{INNER * 3}</section><section>{NOTE}</section><dl><dt>Term</dt><dd>Sense</dd></dl>", f"{BODY}\n{BODY}\n{BODY}\n{NOTE}\nTerm\nSense"),
        (f"<div>{MENU}</div><div class=post><h1>Title</h1><div class=entry><div class=inner>{INNER}</div></div></div>", f"Title\n{BODY}"),
        (f"<div><div class=inner>{INNER}</div>Bare <b>words</b> <a href=x>here</a> at the end<aside>x</aside></div>", f"{BODY}\nBare words here at the end"),
        (f"<div class='page has-sidebar'><div class=sidebar><p>{LONG}</p></div><h1>Title</h1>{INNER}</div><p>Copyright.</p>", f"Title\n{BODY}\nCopyright."),
        (f"<div class='layout widget'>{INNER}</div>", BODY),
        (f"<div id=wrap class='content sidebar-left'><main>{INNER}</main></div><p>{LONG * 2}</p>", BODY),
    ],
)
def test_whole_text_of_other_layouts(page, want):
    assert mainhtml.main_text(page) == want


PROSE = " ".join(["This is a sentence of the article, with commas, and enough words to count as prose."] * 3)
SIDE = "<div class='sidebar'><p>Side text, with things, that are long enough to be prose, maybe, by themselves.</p></div>"


@pytest.mark.parametrize("names", ["container has-sidebar", "layout-with-sidebar", "main no-sidebar", "page with-comments", "post social-post", "content tags-page", "article-widget"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_of_the_layout_set_no_article_aside(names, tag):
    page = f"<nav><a href=x>Home</a></nav><div class='{names}'><{tag}><h1>Title</h1><p>{PROSE}</p><p>{PROSE} More.</p></{tag}>{SIDE}</div><footer>foot</footer>"
    assert mainhtml.main_text(page) == f"Title\n{PROSE}\n{PROSE} More."


def test_formulas_and_figures_stay():
    page = f"<article><p>We see that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {PROSE}</p><figure><svg><title>no</title><text>axis</text></svg><figcaption>Fig. 1</figcaption></figure></article>"
    assert mainhtml.main_text(page) == f"We see that x=2 holds. {PROSE}\naxis\nFig. 1"


@pytest.mark.parametrize("piece", ["<a x=1 ", '<a x="', "<a '\" >", "<div>", "<b>", "<p><b>", "<table><td><i>", "</span><b>", "<li><span>", "<!-- ", "<script>", "&amp", "<div class='sidebar'>"])
def test_a_megabyte_of_broken_markup_takes_seconds(piece):
    began = time.perf_counter()
    mainhtml.main_text(f"<article><p>{PROSE}</p>" + piece * (1_000_000 // len(piece)) + "</span>" * 1000)
    assert time.perf_counter() - began < 20


def _p(i):
    return f"<p>Paragraph number {i} says something of some length, with commas, and goes on for a while so that it counts as prose.</p>"


ARTICLE = "<h1>Heading</h1>" + "".join(map(_p, range(4)))
BOX = "<div class=x><p>A small box beside it all that holds more than one hundred and forty letters in sum, which is no part of any main text and is rather dull.</p></div>"
WHOLE = {
    "form round the body": f"<form id=f><input name=q><label>Search</label><div class=content>{ARTICLE}</div></form>",
    "form round an article": f"<nav><a href=x>Home</a></nav><form><article>{ARTICLE}</article></form><footer>foot</footer>",
    "form that never ends": f"<form class=search action=/s><input>{ARTICLE}",
    "form and a box": f"{BOX}<form><div class=content>{ARTICLE}</div></form>",
    "fieldset": f"<fieldset><legend>x</legend><article>{ARTICLE}</article></fieldset>",
    "dialog": f"<div role=dialog><article>{ARTICLE}</article></div>",
    "shown by script": f"<div style='display:none'><article>{ARTICLE}</article></div>",
    "section of related work": f"<article>{_p(0)}<section class=related-work>{_p(1)}{_p(2)}</section>{_p(3)}</article>",
    "notice period": f"<article>{_p(0)}<div class='notice-period'>{_p(1)}{_p(2)}</div>{_p(3)}</article>",
    "social impact": f"<article>{_p(0)}<section id=social-impact>{_p(1)}{_p(2)}</section>{_p(3)}</article>",
    "two articles": f"<article>{_p(0)}{_p(1)}{_p(0)}</article><article>{_p(2)}{_p(3)}{_p(2)}</article>",
}
PART = {
    "readers": f"<article>{_p(0)}{_p(1)}</article><section class=reader-comments>{_p(2)}</section>",
    "comments inside": f"<article>{_p(0)}{_p(1)}<div class=comment-list>{_p(2)}</div></article>",
    "comments as articles": f"<article>{_p(0)}{_p(1)}</article><article id=div-comment-7 class=comment-body>{_p(2)}{_p(3)}{_p(2)}</article>",
    "cookies": f"<div class=cookie-notice>{_p(2)}</div><article>{_p(0)}{_p(1)}</article>",
    "newsletter": f"<article>{_p(0)}{_p(1)}<div class=newsletter-signup-box>{_p(2)}</div></article>",
    "other posts": f"<article>{_p(0)}{_p(1)}<div class=related-posts><a href=x>{_p(2)}</a></div></article>",
    "links of a topic": f"<article>{_p(0)}{_p(1)}<div class=related-reading><ul><li><a href=x>{_p(2)}</a></li></ul></div></article>",
    "form beside": f"<article>{_p(0)}{_p(1)}</article><form>{_p(2)}</form>",
    "dialog beside": f"<article>{_p(0)}{_p(1)}</article><div role=dialog>{_p(2)}</div>",
    "adverts": f"<article>{_p(0)}{_p(1)}<div class=ad-slot-2>{_p(2)}</div></article>",
    "teasers": f"<article>{_p(0)}{_p(1)}</article><article class=card><a href=x>{_p(2)}</a></article><article class=card>Short one.</article>",
}


def _seen(html):
    text = mainhtml.main_text(f"<html><body>{html}</body></html>")
    return [i for i in range(4) if f"number {i} " in text]


@pytest.mark.parametrize("name", WHOLE)
def test_nothing_of_an_article_is_lost(name):
    assert _seen(WHOLE[name]) == [0, 1, 2, 3]


@pytest.mark.parametrize("name", PART)
def test_what_is_beside_stays_out(name):
    assert _seen(PART[name]) == [0, 1]
