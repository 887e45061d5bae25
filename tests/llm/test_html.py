"""Main text of pages: articles, templates, references and broken markup."""

from __future__ import annotations

import pytest

from lumenveil.llm import html
from lumenveil.llm.queries import op1_html_extraction


def text(source: str) -> str:
    return html.Page(source).text()


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a  b\n\tc</p><p>d</p>", "a b c\nd"),
        ("<p>Fish &amp; chips&nbsp;&#233;&#x41; &lt;b&gt;</p>", "Fish & chips éA <b>"),
        ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<p>a <b>bold</b> <i>word</i><br>next</p>", "a bold word next"),
        ("<ul><li>x<li>y</ul>", "x\ny"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"),
        ("<script>var t = '</p>';</script><style>p{}</style><p>kept</p><noscript>no</noscript>", "kept"),
        ("<!-- gone <p>gone</p> --><p>kept</p><!-- never ends <p>x</p>", "kept"),
        ("<nav><a href=/>home</a></nav><header>site</header><article><header><h1>T</h1></header><p>body</p></article><footer>f</footer>", "T\nbody"),
        ("<div class='ad box'>buy</div><div id=cookie-notice>ok?</div><p>kept</p><form><p>name</p></form>", "kept"),
        ("<div><p>kept</p><div class='comments'><p>first!</p></div></div>", "kept"),
        ("<div role='navigation'>menu</div><div role=main><p>kept</p></div><div>other</div>", "kept"),
        ("<p hidden>x</p><p aria-hidden='true'>y</p><p>z</p>", "z"),
        ("<body class='has-sidebar'><p>kept</p></body>", "kept"),
        ("<p title='a > b'>kept</p>", "kept"),
        ("<p>a < b and c</p>", "a < b and c"),
        ("<p>cut off <b", "cut off"),
        ("<P>Upper</P><DIV CLASS=FOOTER>no</DIV>", "Upper"),
        ("<p><a href=1>one</a> <a href=2>two</a></p><p>real words <a href=3>and a link</a> more words</p>", "real words and a link more words"),
    ],
)
def test_pages(source, want):
    assert text(source) == want


def site(host: str, n: int, extra: str = "") -> list[tuple]:
    frame = "<div class=x><p>{} news portal, all rights and wrongs</p></div>"
    return [(f"http://{host}/{k}", f"<html><body>{frame.format(host)}<div><p>story {k} of {host} tells something</p></div>{extra}</body></html>") for k in range(n)]


def test_recurring_subtrees_go_per_host(spark):
    pages = site("a.example", 7) + site("b.example", 2)
    rows = [(k, url, source) for k, (url, source) in enumerate(pages)]
    got = {r.page_id: (r.text, r.removed) for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"story {k} of a.example tells something", 2) for k in range(7))
    assert got[7][0].startswith("b.example news portal") and got[7][1] == 0


def test_copies_of_one_page_are_no_template(spark):
    source = "<body><div><p>the only story of this site</p></div></body>"
    rows = [(k, "http://c.example/", source) for k in range(20)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the only story of this site"}


def test_query_leaves_no_markup_or_menus(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op1_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and r.text == "\n".join(" ".join(x.split()) for x in r.text.split("\n"))
        assert "</" not in r.text and "&amp;" not in r.text
    assert sum(bool(r.text) for r in rows) > 0.9 * len(rows)


def test_defined_cases(spark):
    long = "<article>" + "<p>word</p>" * 40_000 + "</article>"
    deep = "<div>" * 3_000 + "<p>deep</p>"
    rows = [(1, None, None), (2, "", ""), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (None, "//h/", "<p>y</p>"), (4, "http://h/", long), (5, "not a url", deep)]
    pages = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, host int")
    found = html.extract_text(pages).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and texts[1] == texts[2] == "" and texts[3] == "x" and texts[None] == "y" and texts[5] == "deep"
    assert texts[4].count("word") == 40_000
    assert html.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("place", ["<main>{}</main>", "<div class=page>{}</div>", "<article>{}</article>"])
def test_recurring_subtrees_go_inside_main_and_article(spark, place):
    """Notices on all pages go; a passage that a third of the articles share stays."""
    notice = "<div class=x><div>read our other stories</div></div>"
    body = [notice + f"<div><p>story {k} tells something</p></div>" + ("<p>a shared passage</p>" if k % 3 == 0 else "") for k in range(18)]
    rows = [(k, f"http://a.example/{k}", f"<body>{place.format(x)}</body>") for k, x in enumerate(body)]
    got = {r.page_id: (r.text, r.removed) for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    passage = "" if "page" in place else "\na shared passage"
    assert all(got[k][0] == f"story {k} tells something" + (passage if k % 3 == 0 else "") for k in range(18))
    assert got[1][1] == 2


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div class='layout has-sidebar'><article><p>kept</p></article></div>", "kept"),
        ("<div id=page class='no-ads'><article><p>kept</p></article></div>", "kept"),
        ("<article class='post tag-social'><p>kept</p></article>", "kept"),
        ("<article class=social><p>kept</p></article>", "kept"),
        ("<div class=sidebar><main><p>kept</p></main></div>", "kept"),
        ("<div class=topbar><div class=notice><main class=ad><p>kept</p></main></div></div>", "kept"),
        ("<div class=overlay><p>all the words of a page</p></div>", "all the words of a page"),
        ("<main><p>the main text is here</p></main><article><p>teaser</p></article>", "the main text is here"),
        ("<main><p>the main text is here</p><article><p>teaser</p></article></main>", "the main text is here\nteaser"),
        ("<main><p>x</p><article><p>the main text is here</p></article></main><article><p>teaser</p></article>", "the main text is here"),
        ("<article><h1>T</h1><main><p>body</p></main></article>", "T\nbody"),
        ("<article><p>kept</p><article class=comment><p>first of all comments</p></article></article>", "kept"),
        ("<article><p>kept</p></article><div class='comments-area'><article class=comment-body><p>first</p></article></div>", "kept"),
        ("<form id=all><div class=content><article><p>kept</p></article></div></form>", "kept"),
        ("<form><p>all the words of a page</p></form>", "all the words of a page"),
        ("<article><form><p>all the words of an article</p></form></article>", "all the words of an article"),
        ("<article><p>kept words</p><form><p>name</p></form></article>", "kept words"),
        ("<div class='page no-sidebar'><p>kept</p></div>", "kept"),
        ("<div class='share-enabled'><article><p>kept</p></article></div>", "kept"),
        ("<article><p>a</p><section id=discussion><p>b</p></section><p class=notice>c</p><p>d</p></article>", "a\nb\nc\nd"),
        ("<article><p>a</p><div class=widget><a href=1>more stories</a></div><div class=comments><p>first</p></div></article>", "a"),
        ("<article><p>a</p></article><p class=notice>c</p><section id=discussion><p>b</p></section>", "a"),
        ("<p>kept</p><div class='site-footer'>no</div><div class='social-links'>no</div><div id=comment-12>no</div>", "kept"),
    ],
)
def test_names_never_drop_what_holds_the_text(source, want):
    assert text(source) == want


BODY = [f"Sentence number {k} of the long body, which tells what there is to tell." for k in range(20)]
LONG = "".join(f"<p>{x}</p>" for x in BODY)
STORY = "<article><h1>Title</h1><p>The story is told here, in a sentence.</p></article>"
TOLD = "Title\nThe story is told here, in a sentence."


@pytest.mark.parametrize(
    ("source", "want"),
    [
        *((f"<div class=body><p>The story is told here.</p></div><{tag} class='{name}'><p>first of all remarks</p></{tag}>", "The story is told here.") for tag, name in (
            ("div", "user-comments"), ("ul", "commentlist-v2"), ("div", "ad-slot-3"), ("div", "adsense"), ("div", "sticky-ad"), ("section", "reader-comments"),
        )),
        (STORY + "<div class=thread><article class=c><p>I like it much.</p></article><article class=c><p>So do I.</p></article></div>", TOLD),
        ("<article class=c><p>one post of many, in a row</p></article><article class=c><p>another post</p></article>", "one post of many, in a row\nanother post"),
        ("<article><p>Intro.</p><div class=social><p>Social effects of the reform were felt by all.</p></div></article>", "Intro.\nSocial effects of the reform were felt by all."),
        ("<article><p>Intro.</p><section class=related><p>Related work goes back to the first days.</p></section></article>", "Intro.\nRelated work goes back to the first days."),
        ("<article><p>Intro.</p><div class=social>Like Share Tweet</div><div class=related><a href=1>More of this.</a> <a href=2>And that.</a></div></article>", "Intro."),
        (f"<article class=t><p>Teaser one</p></article><div>{LONG}</div><article class=u><p>Teaser two</p></article>", "\n".join(BODY)),
        (STORY + "<div><div><p>" + "</p></div><div><p>".join(["A remark of some length by a reader."] * 9) + "</p></div></div>", TOLD),
        ("<p><a href=1>A long sentence that is linked as a whole</a> with bit.</p><p><a href=1>one</a> | <a href=2>two</a>.</p>", "A long sentence that is linked as a whole with bit."),
    ],
)
def test_what_a_block_is_counts_before_its_name(source, want):
    """Pages and their texts, written down by hand."""
    assert text(source) == want


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "x",
        "<article>" * 100_000 + "x",
        "<b>" * 100_000 + "x" + "<p>y" * 50_000,
        "<div>" * 50_000 + "x</b>" * 100_000,
        "<ul><li>" * 50_000 + "x",
        "<table><tr><td>" * 30_000 + "x",
        "<a href='" * 100_000 + "x",
        "<p class=notice>x" * 60_000,
    ],
)
def test_any_markup_takes_one_pass(source):
    import resource
    import time

    begun, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = html.Page(source)
    page.subtrees()
    page.text()
    assert time.perf_counter() - begun < 15
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_query_equals_counting_by_hand(spark, sf_dir):
    """Counting and deletion over the whole table, with dictionaries."""
    import collections
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    host = lambda url: (re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "") or ["", ""])[1].lower()
    contents: dict = collections.defaultdict(set)
    seen: dict = collections.defaultdict(set)
    for r in rows:
        page = html.Page(r.html or "")
        contents[host(r.url)].add(page.text())
        for _, h in page.subtrees():
            seen[host(r.url), h].add(page.text())
    want = []
    for r in rows:
        page, name = html.Page(r.html or ""), host(r.url)
        gone = {k for k, h in page.subtrees() if len(seen[name, h]) >= 2 and (h % 2 == 0 or len(seen[name, h]) >= html.INSIDE_SHARE * len(contents[name]))}
        want.append((r.page_id, r.url, page.text(gone), len(gone)))
    got = [(r.page_id, r.url, r.text, r.removed) for r in html.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_contents=2).collect()]
    assert sorted(got) == sorted(want) and any(n for _, _, _, n in want)
