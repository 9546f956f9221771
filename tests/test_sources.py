import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagedelta import schemas
from pagedelta.config import Settings, read_config
from pagedelta.operators.run import Inputs, run_once
from pagedelta.sources import documents as D
from pagedelta.sources import fetch
from pagedelta.sources.store import Store, retained
from pagedelta.streaming.replay import count_windows, missed_counts, replay

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 7\nSitemap: https://a.org/s1.xml\nsitemap: https://a.org/s2.xml\n"


def test_robots(spark):
    robots = spark.createDataFrame([("a.org", ROBOTS), ("b.org", "Crawl-delay: 0.5"), ("c.org", "")], "netloc string, body string")
    got = {r.netloc: r for r in D.robots_rules(robots).collect()}
    assert got["a.org"].crawl_delay == 7 and got["a.org"].sitemaps == ["https://a.org/s1.xml", "https://a.org/s2.xml"]
    assert got["b.org"].crawl_delay is None and got["c.org"].sitemaps == []
    urls = spark.createDataFrame([("https://a.org/private/x",), ("https://a.org/private/ok",), ("https://a.org/x",), ("https://z.org/private",), ("https://c.org/private",)], "url string")
    allowed = {r.url: r.allowed for r in D.can_fetch(urls, robots).collect()}
    assert allowed == {"https://a.org/private/x": False, "https://a.org/private/ok": False, "https://a.org/x": True, "https://z.org/private": True, "https://c.org/private": True}


def urlset(*urls, ns=NS, p=""):
    return f"<?xml version='1.0'?><{p}urlset {ns}>" + "".join(f"<{p}url><{p}loc> {u} </{p}loc><{p}lastmod>2024</{p}lastmod></{p}url>" for u in urls) + f"</{p}urlset>"


def test_sitemaps(spark):
    index = f"<sitemapindex {NS}><sitemap><loc>https://a.org/c1.xml</loc></sitemap><sitemap><loc>https://a.org/c2.xml.gz</loc></sitemap></sitemapindex>"
    docs = {
        "https://www.a.org/sitemap.xml": index,
        "https://a.org/c1.xml": urlset("https://a.org/1", "https://a.org/2?a=1&amp;b=2"),
        "https://a.org/c2.xml.gz": gzip.compress(urlset("https://a.org/3", "https://a.org/1", ns='xmlns:s="x"', p="s:").encode()),
        "https://a.org/sitemap.xml": urlset("https://a.org/4", "https://a.org/5")[:-30],
        "https://www.a.org/sitemap_index.xml": "<html>no</html>",
    }
    documents = spark.createDataFrame([(u, b if isinstance(b, bytes) else b.encode()) for u, b in docs.items()], "url string, body binary")
    sites = spark.createDataFrame([("a.org", None)], "domain string, sitemaps array<string>")
    robots = spark.createDataFrame([], "netloc string, body string")
    candidates = D.sitemap_candidates(sites, robots)
    assert [r.url for r in candidates.orderBy("pos").collect()] == ["https://www.a.org/sitemap.xml", "https://www.a.org/sitemap_index.xml", "https://a.org/sitemap.xml"]
    got = D.sitemap_urls(candidates, documents).orderBy("ordinal").collect()
    assert [r.url for r in got] == ["https://a.org/1", "https://a.org/2?a=1&b=2", "https://a.org/3", "https://a.org/4", "https://a.org/5"]
    assert got[0].lastmod == "2024"
    assert D.sitemap_urls(candidates, documents, 2).count() == 2


def test_sitemap_depth_is_bounded(spark):
    chain = [(f"u{i}", f"<sitemapindex {NS}><sitemap><loc>u{i + 1}</loc></sitemap></sitemapindex>".encode()) for i in range(6)]
    chain[3] = ("u3", urlset("https://a.org/deep").encode())
    docs = spark.createDataFrame(chain, "url string, body binary")
    at = spark.createDataFrame([("a.org", 0, "u0")], "domain string, pos int, url string")
    assert [r.url for r in D.sitemap_urls(at, docs).collect()] == ["https://a.org/deep"]
    chain[3], chain[4] = ("u3", chain[2][1].replace(b"u3", b"u4")), ("u4", urlset("https://a.org/deep").encode())
    assert D.sitemap_urls(at, spark.createDataFrame(chain, "url string, body binary")).count() == 0


def test_patterns(spark):
    urls = spark.createDataFrame([("a", "/blog/1"), ("a", "/blog/tag/1"), ("a", "/x"), ("b", "/x")], "domain string, url string")
    sites = spark.createDataFrame([("a", ["/blog"], ["/tag"]), ("b", [], [])], "domain string, include_patterns array<string>, exclude_patterns array<string>")
    assert sorted((r.domain, r.url) for r in D.filter_patterns(urls, sites).collect()) == [("a", "/blog/1"), ("b", "/x")]


def test_feeds(spark):
    item = "<item><title>T{0}</title><link>https://a.org/{0}</link><pubDate>Mon</pubDate><description>{1}</description></item>"
    rss = "<rss><channel>" + "".join(item.format(i, "x" * (200 + i)) for i in range(60)) + "<item><title>no link</title></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>A</title><link rel='self' href='https://b.org/self'/><link href='https://b.org/1'/><updated>2024</updated><summary>s</summary></entry></feed>"
    docs = spark.createDataFrame(
        [("https://www.a.org/feed", "text/html", "<p>no</p>"), ("https://www.a.org/rss", "text/plain", rss), ("https://www.a.org/rss.xml", "application/xml", "x"), ("https://b.org/own", "x", atom)],
        "url string, content_type string, body string",
    )
    sites = spark.createDataFrame([("a.org", None), ("b.org", ["https://b.org/own"])], "domain string, feeds array<string>")
    feeds = D.discover_feeds(sites, docs)
    assert {(r.domain, r.url) for r in feeds.collect()} == {("a.org", "https://www.a.org/rss"), ("b.org", "https://b.org/own")}
    got = {r.url: r for r in D.feed_entries(feeds, docs).collect()}
    assert len(got) == 51 and got["https://a.org/0"].summary == "x" * 200 and got["https://a.org/1"].summary == "x" * 200 + "..."
    assert (got["https://b.org/1"].title, got["https://b.org/1"].published) == ("A", "2024")


def test_client_waits_and_retries():
    slept, calls, now = [], [], [0.0]

    def transport(url, agent, timeout):
        calls.append(url)
        if "down" in url:
            raise OSError
        return fetch.Response(503 if len(calls) == 1 else 200, url)

    client = fetch.Client(transport, delay=2, sleep=slept.append, clock=lambda: now[0])
    assert client.get("https://a.org/1").status == 200 and len(calls) == 2
    assert client.get("https://a.org/2").status == 200 and slept == [1.0, 2.0]
    assert client.get("https://b.org/down") is None and len(calls) == 7


def test_status_rows():
    html = fetch.Response(200, "https://a.org/2", {"content-type": "text/html"}, b'<META name="robots" content="NOINDEX">', 301)
    assert fetch.status_of("https://a.org/1", html) == ("https://a.org/1", 301, "https://a.org/2", True, None)
    assert fetch.status_of("u", None) == ("u", None, None, False, None)


def test_fetch_by_host(spark):
    def client():
        return fetch.Client(lambda u, a, t: fetch.Response(404 if "gone" in u else 200, u, {"content-type": "text/html"}, u.encode()), delay=0)

    urls = spark.createDataFrame([("https://a.org/1",), ("https://b.org/2",), ("https://a.org/gone",)], "url string")
    assert {r.url: bytes(r.body) for r in fetch.fetch(urls, client).collect()} == {"https://a.org/1": b"https://a.org/1", "https://b.org/2": b"https://b.org/2"}
    assert {r.url: r.status_code for r in fetch.check_status(urls, client).collect()} == {"https://a.org/1": 200, "https://b.org/2": 200, "https://a.org/gone": 404}


PAGE = "<html><title>{0}</title><body><article><h1>{0}</h1><p>{1}</p></article></body></html>"


def inputs(spark, pages):
    captures = spark.createDataFrame([("a.org", u, PAGE.format(t, b)) for u, (t, b) in pages.items()], "domain string, url string, html string")
    sitemap = spark.createDataFrame([("https://a.org/sitemap.xml", urlset(*pages).encode())], "url string, body binary")
    return Inputs(
        spark.createDataFrame([], "netloc string, body string"), sitemap, spark.createDataFrame([], "url string, content_type string, body string"), captures,
        spark.createDataFrame([], schemas.URL_STATUS),
    )


CONFIG = read_config({"settings": {"max_hash_per_domain": 50, "other": 1}, "competitors": [{"name": "A", "domain": "a.org"}]})


def test_config():
    assert CONFIG.settings == Settings(max_hash_per_domain=50) and Settings().removal_threshold_runs == 2


def test_runs_and_replay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = {f"https://a.org/{i}": (f"T{i}", f"Text of page number {i} is here.") for i in range(4)}
    assert run_once(store, CONFIG, inputs(spark, one), datetime(2024, 1, 1)) == 1
    assert store.load_changes().count() == 0 and store.load_state().count() == 4
    two = one | {"https://a.org/0": ("New", "Text of page number 0 is other now."), "https://a.org/9": ("N", "x")}
    run_once(store, CONFIG, inputs(spark, two), datetime(2024, 1, 2))
    assert sorted(r.change_type for r in store.load_changes().collect()) == ["content_update", "h1_change", "new_page", "title_change"]
    assert store.load_changes().count() == 4 and store.pointer()["run"] == 2
    assert store.load_sites().first().total_urls_discovered == 5
    store.publish(f"file://{tmp_path}/out", 3)
    assert spark.read.json(f"file://{tmp_path}/out/changes").count() == 3
    # The same runs as a stream leave the same events.
    source = tmp_path / "captures"
    streamed = Store(spark, f"file://{tmp_path}/t")
    for k, pages in enumerate((one, two), 1):
        rows = inputs(spark, pages).captures.withColumns({"run": F.lit(k), "run_ts": F.lit(datetime(2024, 1, k))})
        rows.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("domain string, url string, html string, run int, run_ts timestamp").parquet(str(source))

    def run_one(rows, run, run_ts):
        found = {r.url: None for r in rows.select("url").collect()}
        own = inputs(spark, dict.fromkeys(found, ("", "")))
        own.captures = rows.select("domain", "url", "html")
        run_once(streamed, CONFIG, own, run_ts)

    replay(stream, run_one, streamed, str(tmp_path / "cp")).awaitTermination()
    ids = lambda s: sorted(r.id for r in s.load_changes().select("id").collect())
    assert ids(streamed) == ids(store)


def test_retention(spark):
    log = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 10).alias("run"))
    assert [r.seq for r in retained(log, 3, ("run",), ("seq",)).collect()] == [9, 19, 29]


def test_weekly_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    from pagedelta.plans import fixtures

    log = fixtures.log(spark, "/root/testdata/sf0.001")
    log.write.parquet(str(tmp_path / "log"))
    stream = count_windows(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    stream.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, count_windows(log).collect()))


def test_missed_runs_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [("d", "u", 1, True), ("d", "u", 2, False), ("d", "v", 1, True), ("d", "v", 2, False), ("d", "u", 3, False), ("d", "v", 3, True)]
    spark.createDataFrame(rows, "domain string, url string, run int, found boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = missed_counts(spark.readStream.schema("domain string, url string, run int, found boolean").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("missed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("missed").collect()] == [("d", "u", 3, 2)]
