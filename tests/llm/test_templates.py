"""Template text of hosts whose pages are not all alike."""

from pagedelta.llm import wrapper

PAGES = "page_id long, url string, html string"
PAGE = "<html><body><div class=page><h1>Head {0}</h1><p>One {0}<p>Two {0} and more of it<div class=kicker>Written by us</div></div></body></html>"


def texts(spark, pages):
    rows = spark.createDataFrame([(i, f"https://a.org/{i}", p) for i, p in enumerate(pages)], PAGES).repartition(3)
    return {r.page_id: r.text for r in wrapper.main_text(rows).collect()}


def test_odd_pages_do_not_end_a_template(spark):
    other = "<html><body><table class=list><tr><td>Entry {0} of the list<tr><td>Written by us</table></body></html>"
    pages = [PAGE.format(i) for i in range(12)] + [None, "", "<h1>Error 500</h1>"] + [other.format(i) for i in range(5)]
    got = texts(spark, pages)
    assert all(got[i] == f"Head {i}\nOne {i}\nTwo {i} and more of it" for i in range(12))
    assert (got[12], got[13], got[14]) == ("", "", "Error 500")


def test_copies_of_a_page_are_not_a_template(spark):
    got = texts(spark, [PAGE.format(0)] * 40 + [PAGE.format(i) for i in (1, 2, 3)])
    assert got[0] == got[39] == "Head 0\nOne 0\nTwo 0 and more of it"


def test_long_and_repeated_texts_are_template(spark):
    notice = "All rights in this text are reserved by its owner. " * 20
    page = "<html><body><div class=page><h1>Head {0}</h1><p>One {0}<p>Sent to you from our office<p>Two {0} and more of it<p>" + notice + "<div class=end>" + notice + "</div></div></body></html>"
    got = texts(spark, [page.format(i) for i in range(12)])
    assert all(got[i] == f"Head {i}\nOne {i}\nTwo {i} and more of it" for i in range(12))
