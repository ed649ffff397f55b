"""Pages written by hand with the text that a reader would take from them, and pages made to be slow."""

from __future__ import annotations

import time

import pytest

from quire.llm import dom, pages

ARTICLE = "The town council met on Tuesday to discuss the new bridge, which has been planned for years. Several residents spoke, and most of them were in favour of it."
SECOND = "Work is to begin in the spring, the mayor said, if the money is there by then. A second meeting, open to all, has been called for next month."

PAGES = [
    (f"<html><head><title>T</title><style>x{{}}</style></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav><article><h1>Bridge &amp; road</h1><p>{ARTICLE}</p><p>{SECOND}</p></article><footer>&copy; 2024 The Paper</footer></body></html>", ["Bridge & road", ARTICLE, SECOND]),
    (f"<body><div class=header><a href=/>Site</a></div><div class='content'><h2>A   title\n here</h2><p>{ARTICLE}<p>{SECOND}</div><div class=sidebar><h3>More</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>", ["A title here", ARTICLE, SECOND]),
    (f"<main><article><p>{ARTICLE}</p><script>var a = '<p>no</p>';</script><aside class='ad'>Buy this now</aside><p>{SECOND}</p></article></main><section class=comments><h3>Comments</h3><p>First!</p><p>Nice text, thank you.</p></section>", [ARTICLE, SECOND]),
    (f"<article><p title='5\" tall' data-x=a\"b>{ARTICLE}</p><!-- <p>no</p> --><p>{SECOND}&nbsp;&lt;end&gt;</p></article><form><label>Search</label><input><button>Go</button></form>", [ARTICLE, SECOND + " <end>"]),
]


BARE = [
    (f"<p>{ARTICLE}</p>", [ARTICLE]), (ARTICLE, [ARTICLE]), (f"<div>{ARTICLE}</div>", [ARTICLE]), ("One word", ["One word"]), ("<p>Short.</p>", ["Short."]),
    (f"<table><tr><td>{ARTICLE}</td></tr></table>", [ARTICLE]), ("<table><tr><td>Salt</td><td>4 g</td></tr><tr><td>Sand</td><td>5 g</td></tr></table>", ["Salt", "4 g", "Sand", "5 g"]),
    (f"<html><body><p>{ARTICLE}</p><p>{SECOND}</p></body></html>", [ARTICLE, SECOND]), (f"<p>{ARTICLE}</p><p>{SECOND}</p><p>{ARTICLE}</p>", [ARTICLE, SECOND, ARTICLE]),
    (f"<ul><li>{ARTICLE}</li><li>{SECOND}</li></ul>", [ARTICLE, SECOND]), (f"<h1>Bridge</h1><p>{ARTICLE}</p>", ["Bridge", ARTICLE]), (f"<body><h2>One</h2>{ARTICLE}<br>{SECOND}</body>", ["One", f"{ARTICLE} {SECOND}"]),
    (f"<nav><a href=/>Home</a> | <a href=/n>News</a></nav><p>{ARTICLE}</p><p>{SECOND}</p>", [ARTICLE, SECOND]), (f"<p>{ARTICLE}</p><p>{SECOND}</p><footer>&copy; 2024 The Paper</footer>", [ARTICLE, SECOND]),
    (f"<form><input><button>Go</button></form><div>{ARTICLE}</div>", [ARTICLE]), (f"<section><p>{ARTICLE}</p></section>", [ARTICLE]), ("", []), ("<nav><a href=/>Home</a></nav>", []),
]


@pytest.mark.parametrize("cases", [PAGES, BARE])
def test_pages_by_hand(cases):
    got = pages.main_texts([source for source, _ in cases], pages.model())
    assert got == ["\n\n".join(want) for _, want in cases]


def nodes(source):
    page = dom.Page(source)
    return [(page.tag[n], t) for n, t in page.pieces if t]


def test_reading():
    assert nodes("a < b <p>c") == [("#root", "a "), ("#root", "<"), ("#root", " b "), ("p", "c")]
    assert nodes("<p>one<a href='x") == [("p", "one")]  # cut short inside a tag
    assert nodes("<i>x</b>y</i>z") == [("i", "x"), ("i", "y"), ("#root", "z")]
    assert nodes("<b><div>x</b>y</div>z</b>w") == [("div", "x"), ("div", "y"), ("b", "z"), ("#root", "w")]
    assert nodes("<ul><li>a<ul><li>b</ul><li>c</ul>d") == [("li", "a"), ("li", "b"), ("li", "c"), ("#root", "d")]
    assert nodes("<p>a<div>b</div>c") == [("p", "a"), ("div", "b"), ("#root", "c")]
    assert nodes("<table><tr><td>a<td>b<tr><td>c</table>d") == [("td", "a"), ("td", "b"), ("td", "c"), ("#root", "d")]
    assert nodes('<p class="a>b">x</p>') == [("p", "x")] and nodes("<p a'b>x<p>y") == [("p", "x"), ("p", "y")]


@pytest.mark.parametrize("unit", ["<a x ", "<!x", "<?x", "<a x='", "<a x=\"<b y='", "data-", "<b>", "<i></b>", "<b><div><i>", "</b>", "<p>", "a=/ ", "<script", "&amp;", "=a"])
def test_long_pages_take_time_in_proportion(unit):
    def seconds(n, before="", after=""):
        source = before + unit * (n // len(unit)) + after
        began = time.process_time()
        dom.Page(source)
        return time.process_time() - began

    for before, after in (("", ""), ("<a ", "/>"), ("<div>" + "<i>" * 1000, ""), ("<a ", " x/>")):
        short, long = seconds(100_000, before, after), seconds(800_000, before, after)
        assert long < 16 * max(short, 0.02), (unit, before, short, long)


def test_a_page_of_four_megabytes():
    began = time.process_time()
    dom.Page("<a x " * 800_000)
    dom.Page("<p>" + "<b>x</b> " * 450_000)
    assert time.process_time() - began < 25


def test_extra_columns_nulls_and_repeated_rows(spark):
    rows = [(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (None, None, PAGES[0][0], None), (2, "v", None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "7 as n_chars")
    got = sorted(map(tuple, pages.extract(df).collect()), key=repr)
    text = "\n\n".join(PAGES[0][1])
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "v", "", 0)], key=repr)
