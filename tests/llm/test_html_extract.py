"""Extraction on pages written for the purpose, and on the given pages against what their makers put in."""

import re
from html import unescape

import pytest

from siteworks.llm.html_extract import extract, extract_pages

P = "<p>{} This sentence is long enough, as it should be, to earn points for its paragraph.</p>"
LONG = [f"Text {i}. This sentence is long enough, as it should be, to earn points for its paragraph." for i in range(9)]


def para(*numbers):
    return "".join(f"<p>{LONG[i]}</p>" for i in numbers)


def test_furniture_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></ul></nav><div class="cookie-notice">We use cookies, really, all of us do, every day.</div>
    <div id="content"><h1>Title &amp; more</h1>{para(0, 1)}<div class="ad">Buy, buy, buy, now, and here, and everywhere, always.</div>{para(2)}
    <ul class="share"><li><a href=x>Tweet</a></ul><form>Name, mail, and all, and so on, <input> please now</form></div>
    <div class="sidebar">{para(3)}</div><div id="comments">{para(4, 5, 6, 7)}</div><footer>&copy; us</footer></body></html>"""
    assert extract(page).split("\n") == ["Title & more", *LONG[:3]]


def test_article_with_parts_is_whole():
    page = f"<body><article><h1>Title</h1><p>Lead.</p><div class=body>{para(0, 1, 2)}<h2>Sub</h2>{para(3)}</div><footer>f</footer></article><p>Other, text, beside, it.</p></body>"
    assert extract(page).split("\n") == ["Title", "Lead.", *LONG[:3], "Sub", LONG[3]]


def test_siblings_are_taken():
    page = f"<div><div>{para(0, 1, 2)}</div><div>{para(3, 4)}</div><div><a href=x>{LONG[5]}</a></div></div>"
    assert extract(page).split("\n") == LONG[:5]


def test_left_out_end_tags_and_space():
    page = f"<article><p>a\n\t b&nbsp;c<br>d<p><b>{LONG[0]}<p>e &lt;f&gt; &amp &am &#x41;<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>"
    assert extract(page).split("\n") == ["a b c d", LONG[0], "e <f> & &am A", "one", "two", "x", "y", "z"]


def test_links_are_discounted():
    menu = "".join(f"<li><a href=/{i}>{LONG[i]}</a></li>" for i in range(9))
    assert extract(f"<div><ul>{menu}</ul></div><div>{para(1)}</div>").split("\n") == [LONG[1]]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain words", "plain words"), ("<p>short</p>", "short"), ("<script>x", ""), ("<!-- <p>a</p>", ""), ("<article><p>hi</p>", "hi"),
        ("<p>a < b and c</p>", "a < b and c"), ('<p title="a>b">x</p>', "x"), ('<p title="a>x</p>', "x"), ("<body hidden>x", "x"), ("</div></p>z", "z"),
        ("<div style='display: none'>no</div><div>yes</div>", "yes"), ("<textarea><p>no</textarea>ok", "ok"), ("\0<p>a\0b", "\0 a\0b".replace("\0 ", "\0\n")),
    ],
)
def test_small_and_broken_pages(page, text):
    assert extract(page) == text


def test_deep_and_long_pages_are_linear():
    assert extract("<div>" * 50_000 + LONG[0]) == LONG[0]
    assert extract("<b><p>" * 20_000 + "x") == "x"
    assert len(extract("<article>" + para(0) * 20_000).split("\n")) == 20_000
    assert extract('<a "' * 5_000 + LONG[0]) == ""


def test_given_pages(spark):
    """The makers' pages hold their article in one element, a line in each paragraph."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in re.split(r"<(?:p|h1)>", inner)]
        assert got[r.page_id].text.split("\n") == [x for x in lines if x]
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_table_with_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "<p>a", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_pages(rows).collect()) == [(0, "", "", 0), (1, "u", "", 0), (1, "u", "a", 1)]
    assert extract_pages(rows.limit(0)).collect() == []


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("size", [100, 5_000, 300_000])
def test_long_attribute_values_are_whole(quote, size):
    value = "<p>leaked, text, of, a, value</p>" * (size // 33 + 1)
    ad = f"<div data-state={quote}{value}{quote} class=ad><p>{LONG[1]}</p></div>"
    page = f"<article data-src = {quote}{value}{quote}>{para(0)}{ad}<img src={quote}{value}{quote}>{para(2)}</article>"
    assert extract(page).split("\n") == [LONG[0], LONG[2]]


def test_quotes_without_end():
    assert extract(f"<article title='a>b' class=\"x>{para(0)}</article>".replace("<p>", "<p id=it's>")) == LONG[0]
    assert extract("<p title='>x" * 100_000).split("\n") == ["x"] * 50_000  # every other tag stands in a value
    assert extract('<p title=">x' + "<p title='>x" * 99_999).split("\n") == ["x"] * 50_001
    assert extract('<p title=">x' * 3 + "<p>y") == "x\nx\ny"
