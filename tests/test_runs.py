"""Runs that die half way, discovery probes, runs from an in-process network, plans of change detection."""

import gzip
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_sources import CONFIG, NS, PAGE, inputs, urlset

from pagedelta import schemas
from pagedelta.config import read_config
from pagedelta.functions import text as T
from pagedelta.operators import changes as C
from pagedelta.operators.run import crawl, run_once
from pagedelta.sources import documents as D
from pagedelta.sources.fetch import Response
from pagedelta.sources.store import Store, import_changes


class Dies(Exception):
    pass


class Failing:
    """A file system of which one operation, by number, raises, before or after it is done."""

    def __init__(self, fs, at, after):
        self.fs, self.at, self.after, self.n = fs, at, after, 0

    def __getattr__(self, name):
        own = getattr(self.fs, name)
        if name not in ("create", "rename", "delete"):
            return own

        def call(*args):
            self.n += 1
            if self.n == self.at and not self.after:
                raise Dies
            out = own(*args)
            if self.n == self.at:
                raise Dies
            return out

        return call


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_pointer_is_never_lost(spark, tmp_path, monkeypatch, at, after):
    store = Store(spark, f"file://{tmp_path}/s")
    for run in (1, 2, 3):
        store._turn(run, datetime(2024, 1, run))
    real = Store._fs

    def fs(self, path):
        got, where = real(self, path)
        failing.fs = got
        return failing, where

    failing = Failing(None, at, after)
    monkeypatch.setattr(Store, "_fs", fs)
    try:
        store._turn(4, datetime(2024, 1, 4))
    except Dies:
        pass
    monkeypatch.setattr(Store, "_fs", real)
    assert store.pointer()["run"] in (3, 4)
    store._turn(4, datetime(2024, 1, 4))
    assert store.pointer() == {"run": 4, "run_ts": "2024-01-04T00:00:00"}


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    pages = {f"https://a.org/{i}": (f"T{i}", f"Text {i}.") for i in range(4)}
    run_once(store, CONFIG, inputs(spark, pages), datetime(2024, 1, 1))
    turn = Store._turn
    monkeypatch.setattr(Store, "_turn", lambda *_: (_ for _ in ()).throw(Dies()))
    more = pages | {"https://a.org/9": ("N", "x")}
    with pytest.raises(Dies):
        run_once(store, CONFIG, inputs(spark, more), datetime(2024, 1, 2))
    assert store.pointer()["run"] == 1 and store.load_changes().count() == 0 and store.load_state().count() == 4
    monkeypatch.setattr(Store, "_turn", turn)
    run_once(store, CONFIG, inputs(spark, more), datetime(2024, 1, 2))
    assert [r.url for r in store.load_changes().collect()] == ["https://a.org/9"] and store.load_state().count() == 5


def test_the_cap_of_a_site_counts_what_the_filters_leave(spark):
    docs = {"a.xml": urlset(*(f"https://a.org/no/{i}" for i in range(5))), "b.xml": urlset(*(f"https://a.org/{i}" for i in range(3)))}
    documents = spark.createDataFrame([(u, x.encode()) for u, x in docs.items()], "url string, body binary")
    candidates = spark.createDataFrame([("a.org", 0, "a.xml"), ("a.org", 1, "b.xml")], "domain string, pos int, url string")
    got = D.sitemap_urls(candidates, documents, 5, lambda urls: urls.filter("url NOT LIKE '%/no/%'"))
    assert sorted(r.url for r in got.collect()) == [f"https://a.org/{i}" for i in range(3)]


def test_feeds_keep_their_configured_order(spark):
    rss = "<rss><channel><item><title>{}</title><link>https://a.org/1</link></item></channel></rss>"
    docs = spark.createDataFrame([("https://z.org/f", "", rss.format("Z")), ("https://a.org/f", "", rss.format("A"))], "url string, content_type string, body string")
    sites = spark.createDataFrame([("a.org", ["https://z.org/f", "https://a.org/f"])], "domain string, feeds array<string>")
    assert [r.title for r in D.feed_entries(D.discover_feeds(sites, docs), docs).collect()] == ["Z"]


def test_robots_of_another_agent_do_not_count(spark):
    body = "User-agent: other\nCrawl-delay: 30\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 4\n"
    robots = spark.createDataFrame([("a.org", body)], "netloc string, body string")
    urls = spark.createDataFrame([("https://a.org/x",), ("https://b.org/x",)], "url string")
    assert {r.url: r.delay for r in D.with_delay(urls, robots, 2).collect()} == {"https://a.org/x": 4.0, "https://b.org/x": 2.0}
    assert D.can_fetch(urls, robots).filter("allowed").count() == 2


def answers(docs):
    """An in-process site: url to (content type, body); the rest is 404. A closure, so that workers need not import this file."""

    def transport(url, agent, timeout):
        assert timeout == 7
        if url not in docs:
            return Response(404, url)
        kind, body = docs[url]
        return Response(200, url, {"content-type": kind}, body if isinstance(body, bytes) else body.encode())

    return transport


def test_a_run_from_the_network(spark, tmp_path):
    index = f"<sitemapindex {NS}><sitemap><loc>https://a.org/c.xml.gz</loc></sitemap></sitemapindex>"
    feed = "<rss><channel><item><title>F</title><link>https://a.org/fed</link><pubDate>Mon</pubDate></item></channel></rss>"
    pages = {f"https://a.org/{i}": ("text/html; charset=latin-1", PAGE.format(f"T{i}", f"Téxt {i} of it.").encode("latin-1")) for i in range(6)}
    pages |= {"https://a.org/private/1": ("text/html", "x"), "https://a.org/5.pdf": ("application/pdf", b"%PDF"), "https://a.org/fed": ("text/html", PAGE.format("F", "Fed"))}
    listed = [u for u in pages if u != "https://a.org/fed"]

    def net(urls):
        docs = {u: pages[u] for u in urls} | {
            "https://a.org/robots.txt": ("text/plain", "User-agent: *\nDisallow: /private\nCrawl-delay: 1\nSitemap: https://a.org/s.xml\n"),
            "https://a.org/s.xml": ("application/xml", index),
            "https://a.org/c.xml.gz": ("application/gzip", gzip.compress(urlset(*(u for u in urls if u != "https://a.org/fed")).encode())),
            "https://www.a.org/rss": ("application/rss+xml", feed),
        }
        return answers(docs)

    raw = {"request_delay_seconds": 0, "request_timeout_seconds": 7, "html_only": True, "max_changes_history": 3, "removal_threshold_runs": 1}
    config = read_config({"settings": raw, "competitors": [{"name": "A", "domain": "a.org"}]})
    store = Store(spark, f"file://{tmp_path}/s")
    crawl(store, config, datetime(2024, 1, 1), net([*listed, "https://a.org/fed"]), lambda seconds: None)
    state = {r.url: r for r in store.load_state().collect()}
    assert set(state) == {*pages} - {"https://a.org/private/1"}
    assert state["https://a.org/1"].content_snippet == "t1 téxt 1 of it." and state["https://a.org/5.pdf"].content_hash == ""
    crawl(store, config, datetime(2024, 1, 2), net([u for u in listed if u != "https://a.org/0"] + ["https://a.org/fed"]), lambda seconds: None)
    assert [(r.change_type, r.url) for r in store.load_changes().collect()] == [("page_removed", "https://a.org/0")]
    crawl(store, config, datetime(2024, 1, 3), net([*listed, "https://a.org/fed"]), lambda seconds: None)
    assert [(r.change_type, r.url, r.run) for r in store.load_changes(1).collect()] == [("new_page", "https://a.org/0", 3)]
    store.publish(f"file://{tmp_path}/out", 1)
    assert [r.url for r in import_changes(spark, f"file://{tmp_path}/out/changes").collect()] == ["https://a.org/0"]
    assert store.prune(1) == [2] and store.load_changes().count() == 1
    assert not (tmp_path / "s" / "work").exists()


def test_sentences_are_linear(spark):
    def took(words):
        rows = spark.createDataFrame([("word " * words,)], "x string").select(F.size(T.sentences(F.col("x"))).alias("n"))
        began = time.perf_counter()
        assert rows.first().n == -(-words // 15)
        return time.perf_counter() - began

    took(100)
    assert took(64_000) < 3


def test_sites_are_broadcast_to_pages(spark, sf_dir):
    from pagedelta.plans import fixtures as X
    from pagedelta.plans import registry

    prev, curr = registry._pages(spark, sf_dir)
    names = X.site_names(X.base(spark, sf_dir))
    held = []
    changes, _ = C.detect_changes(
        X.as_state(prev), X.as_urls(curr), X.as_extracts(curr), X.as_feeds(curr), X.as_statuses(prev), names, datetime(2024, 1, 31), hold=lambda rows: held.append(rows) or rows
    )
    assert len(held) == 1
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    by_domain = [x for x in joins if "(url#" not in x and "old_url" not in x and "domain#" in x]
    assert by_domain and all("rightHint=(strategy=broadcast)" in x for x in by_domain)


def test_texts_that_did_not_change_do_not_go_to_python(spark):
    row = ("a.org", "https://a.org/1", datetime(2024, 1, 1), datetime(2024, 1, 1), "h", "T", "", "Old text.", [], 2, "", [], None, 0)
    prev = spark.createDataFrame([row], schemas.PAGE_STATE)
    urls = spark.createDataFrame([("a.org", "https://a.org/1", None, "", "sitemap", 0)], schemas.DISCOVERED)
    found = spark.createDataFrame([("a.org", "https://a.org/1", "h", "T", "", [], 2, "", [], "Old text.", False)], schemas.PAGE_EXTRACT)
    held = []
    sites = spark.createDataFrame([("a.org", "A", 1)], schemas.SITES)
    C.detect_changes(prev, urls, found, spark.createDataFrame([], schemas.FEED_ENTRY), spark.createDataFrame([], schemas.URL_STATUS), sites, datetime(2024, 1, 2), hold=lambda rows: held.append(rows) or rows)
    assert held[0].first()["d"] is None
