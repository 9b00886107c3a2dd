"""Attributes as HTML reads them, and classes that name a topic of the article."""

import time

import pytest

from lexilake.llm import pages


def text(html: str) -> str:
    return pages.main_text(pages.page_lines(html), set())[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article><p>one</p><a href="x"">two</a> three</article>', "one two three"),
        ("<article><p title=it's>hello</p></article>", "hello"),
        ('<p title="a>b">x</p>', "x"),
        ("<p data-x='<b>'>y</p>", "y"),
        ('<img alt="never closed> tail <p>more</p>', "tail more"),
        ("<p =x>q</p>", "q"),
        ('<p "quoted">q</p>', "q"),
        ('<div class = "nav">n</div><p>z</p>', "z"),
        ("<div CLASS='nav' class='x'>n</div><p>z</p>", "z"),
        ('<p title="hidden">a</p><div hidden>b</div><div data-hidden=1>c</div>', "a c"),
        ("<p>a < b and c</p", "a < b and c"),
    ],
)
def test_attributes(html, want):
    assert text(html) == want


def test_topics_of_an_article_stay():
    page = '<article><section class="related-work"><p>a</p></section><div class="legal-text">b</div><div id="sharePrice">c</div>{}</article>'
    assert text(page.format("")) == "a b c"
    assert text(page.format('<div class="related-posts"><a href="/x">other</a></div>')) == "a b c"
    for gone in ("notice", "legal-notice", "comment-list", "ad-slot", "share-price comments"):
        assert text(page.format(f'<div class="{gone}">gone</div>')) == "a b c"
    assert text('<div class="share-price">c</div><p>d</p>') == "d"


def test_topics_that_a_neighbour_shares_go(spark):
    page = "<article><p>own {0} of {0}</p><p>more {0}, then again {0}</p><div class='share-box'>tell your friends</div></article>"
    rows = [(i, f"http://h/a/{i}", page.format(w)) for i, w in enumerate(("apples", "pears", "plums"))]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {w} of {w} more {w}, then again {w}" for i, w in enumerate(("apples", "pears", "plums"))}


@pytest.mark.parametrize("piece", ['<a b="', "<a b='", "<a ", '<p title="x" ', "<a =", "<a b = ", '"', "<"])
def test_malformed_tags_take_linear_time(piece):
    start = time.time()
    pages.page_lines(piece * 200_000)
    assert time.time() - start < 20
