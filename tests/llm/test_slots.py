"""Evidence of a host's pages picks the article where names and tags do not; odd nesting costs no more than its length."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pagedelta.llm import wrapper
from pagedelta.llm.common import table

PAGES = "page_id long, url string, html string"
TAGS = "article|aside|dialog|footer|form|header|menu|nav|search"


def text(page):
    return "\n".join(wrapper.chosen(wrapper.blocks(page)))


def texts(spark, pages):
    rows = spark.createDataFrame([(i, f"https://a.org/{i}", p) for i, p in enumerate(pages)], PAGES).repartition(3)
    return {r.page_id: r.text for r in wrapper.main_text(rows).collect()}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>Real text of the page</p></main><article class='teaser'><p>Other story</p></article>", "Real text of the page"),
        ("<div><h1>Head</h1><p>A long story of which this is the text</div><article><p>Other story</article>", "Head\nA long story of which this is the text"),
        ("<main><h1>H</h1><article><p>The story itself, long enough</article><p>Ask us</main>", "The story itself, long enough"),
        ("<main><p>A long text that is the page's own</p><article><p>Teaser</article></main>", "A long text that is the page's own\nTeaser"),
        ("<article><p>Text<div class='related-posts'><ul><li><a href=/>Other</a></ul></div><div id=reader-opinions><p>Nice</div></article>", "Text"),
    ],
)
def test_pages_that_stand_alone(page, want):
    assert text(f"<html><body>{page}</body></html>") == want


def test_hosts_without_tags_or_names(spark):
    page = "<html><body><div><div><a href=/>Home</a></div><div><a href=/a>About {0}</a></div></div><div class=k1>Buy thing {0} today</div><div class=k2><h2>Head {0}</h2><p>{1}<p>Last {0}</div><div>Since 1999 {0}</div></body></html>"
    body = "Words of the story number {0} that go on for a while and then end, as stories do."
    got = texts(spark, [page.format(i, body.format(i)) for i in range(4)] + ["<html><body><div class=k2><h2>Short</h2><p>x</div><div class=k1>Buy a very long thing that is of no interest</div></body></html>"])
    assert all(got[i] == f"Head {i}\n{body.format(i)}\nLast {i}" for i in range(4)) and got[4] == "Short\nx"


def test_a_notice_on_every_page_is_no_content(spark):
    notice = "All rights in this text are reserved by its owner, who lives by the sea and writes. " * 9
    page = "<html><body><section><p>{0}</section><section><blockquote>Story {1}: words that only this page has.</blockquote></section></body></html>"
    got = texts(spark, [page.format(notice, i) for i in range(9)])
    assert all(got[i] == f"Story {i}: words that only this page has." for i in range(9))


def test_teasers_and_several_articles(spark):
    page = "<html><body><div><h1>Head {0}</h1><p>{1}</div><article><p>Other story {0}</article></body></html>"
    body = "Words of the story number {0} that go on for a while and then end, as stories do."
    got = texts(spark, [page.format(i, body.format(i)) for i in range(4)])
    assert all(got[i] == f"Head {i}\n{body.format(i)}" for i in range(4))
    both = "<html><body><p>Site {0}</p><article><h1>One {0}</h1><p>First {0} of the two</article><article><h1>Two {0}</h1><p>Second {0} of the two</article></body></html>"
    got = texts(spark, [both.format(i) for i in range(4)])
    assert all(got[i] == f"One {i}\nFirst {i} of the two\nTwo {i}\nSecond {i} of the two" for i in range(4))


def test_the_pages_table_without_its_tags(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", rf"<({TAGS})\b[^>]*>", "<div>"), rf"</({TAGS})>", "</div>"), 'class="[^"]*"', 'class="x"')
    want = {r.page_id: r.text for r in wrapper.main_text(pages).collect()}
    urls = {r.page_id: re.sub(r"^\w+://([^/?#]*).*", r"\1", r.url, flags=re.S).lower() for r in pages.collect()}
    got = {r.page_id: r.text for r in wrapper.main_text(pages.withColumn("html", plain)).collect()}
    several = [i for i, u in urls.items() if list(urls.values()).count(u) > 1]
    assert len(several) > 200 and all(got[i] == want[i] for i in several)


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "x", "<div>x" * 30_000, "<b>" * 60_000 + "</i>" * 60_000, "<i>" * 60_000 + "<p>x" * 60_000, "<p><b>" * 40_000, "<ul><li>" * 40_000 + "</b>" * 40_000,
        "<a href=/>x" * 50_000, "</div>" * 200_000, "<span hidden>" * 50_000 + "</i>" * 50_000, "<table><tr><td>" * 20_000, "<article><p>x</article>" * 20_000, "<div><p>x</p></div>" * 30_000,
    ],
    ids=lambda p: p[:16],
)
def test_nesting_and_stray_tags_are_linear(page):
    began = time.process_time()
    found = wrapper.blocks(page)
    wrapper.chosen(found, None, frozenset(wrapper.slot_of(b.path) for b in found[:3]))
    assert time.process_time() - began < 12


def test_deep_elements_count_as_the_deepest():
    page = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>after</p></article><footer>no</footer>"
    assert text(page) == "deep\nafter"
