"""Damaged documents, hosts met on the way, and sites that fail alone; runs go through an in-process network."""

import gzip
import http.client
import json
import random
import time
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_runs import answers
from test_sources import NS, PAGE, urlset

from pagedelta.config import read_config
from pagedelta.operators.run import crawl
from pagedelta.sources import documents as D
from pagedelta.sources import fetch
from pagedelta.sources import markup as M
from pagedelta.sources.fetch import Response
from pagedelta.sources.store import Store

# ---------------------------------------------------------------- the reader


def read(text, roots=D._SITEMAPS, step=7):
    return [(root, {k: v[0][0] for k, v in r.items()}) for root, r in M.records([text[i : i + step] for i in range(0, len(text), step)], roots)]


@pytest.mark.parametrize(
    "damage, want",
    [
        ("<urlset><url><loc>a</loc><lastmod>1</lastmod></url><url><loc>b</loc><lastmod>2024-0", [("a", "1"), ("b", "2024-0")]),
        ("<urlset><url><loc>a</loc></url><url><loc>b</lo", [("a", None), ("b", None)]),
        ("<urlset><url><loc>a?x=1&y=2</loc><lastmod>1 < 2 & 3</lastmod></url></urlset>", [("a?x=1&y=2", "1 < 2 & 3")]),
        ("<urlset><url><loc>a<lastmod>1</url><url><loc>b</url></urlset>", [("a", "1"), ("b", None)]),
        ("<urlset><url><loc>a</loc><url><loc>b</loc></b></i></url></urlset><url><loc>c</loc></url>", [("a", None), ("b", None)]),
        ("<s:urlset xmlns:s='x'><s:url><s:loc>a</s:loc><i:image><i:loc>no</i:loc></i:image><s:lastmod>1</s:lastmod></s:url></s:urlset>", [("a", "1")]),
        ("<!-- <urlset> --><?xml x?><!DOCTYPE x><urlset><!--<url><loc>no</loc></url>--><url><loc><![CDATA[a&amp;<b>]]>&#33;</loc></url>", [("a&amp;<b>!", None)]),
        ("<urlset><url a='>' b=\"<\"><loc>a</loc></url><url><loc c='>b</loc></url></urlset>", [("a", None), ("b", None)]),
        ("<html><urlset><url><loc>a</loc></url></urlset></html>", []),
        ("<urlset/><url><loc>a</loc></url>", []),
        ("", []),
    ],
)
def test_damaged_sitemaps(damage, want):
    for step in (1, 2, 7, 10**6):
        assert [(r.get("loc"), r.get("lastmod")) for _, r in read(damage, step=step)] == want


@given(st.text("<>/&;!-[]'\"=ulr se CDATAxt:", max_size=80), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read_alike_in_any_pieces(text, step):
    text = "<urlset><url><loc>" + text
    assert read(text, step=step) == read(text, step=10**6)


def test_pieces_of_gzip_members_and_encodings():
    body = "é<urlset>".encode()
    two = gzip.compress(body[:5]) + gzip.compress(body[5:] * 200_000) + b"\0" * 9
    assert b"".join(M.inflated(two)) == body[:5] + body[5:] * 200_000 and b"".join(M.inflated(body)) == body
    for bad in (two[:-40], two + b"junk", gzip.compress(body * 99)[:-9], b"\x1f\x8b", b"\x1f\x8b" + b"x" * 99, two[:60] + b"\xff" * 8 + two[68:]):
        with pytest.raises(M.Damaged):
            next(M.inflated(bad))
    for name in ("utf-8", "utf-16", "latin-1"):
        text = f"<?xml version='1.0' encoding='{name}'?><a>é€</a>" if name != "latin-1" else "<?xml version='1.0' encoding='latin-1'?><a>é</a>"
        raw = text.encode(name)
        assert "".join(M.decoded_text(raw[i : i + 300] for i in range(0, len(raw), 300))) == text
    assert "".join(M.decoded_text([b"<?xml encoding='base64'?>\xff"])) == "<?xml encoding='base64'?>�"


@pytest.mark.parametrize("part", ["<!--", "<![CDATA[", "<a \"", "<a '\">", "</b>", "<b>", "&amp", "<", "<url>", "<url><loc>x", "<a b='"])
def test_reading_is_linear_and_bounded(part):
    began = time.process_time()
    text = "<urlset>" + part * (1_500_000 // len(part))
    for _ in M.records((text[i : i + M.CHUNK] for i in range(0, len(text), M.CHUNK)), D._SITEMAPS):
        pass
    assert time.process_time() - began < 10


def test_a_large_sitemap_is_read_in_rows(spark):
    n = 300_000
    body = b"<urlset>" + b"".join(b"<url><loc>https://a.org/%d</loc><lastmod>2024</lastmod><x>%s</x></url>" % (i, b"y" * 100) for i in range(n)) + b"</urlset>"
    assert len(body) > 50_000_000
    docs = spark.createDataFrame([("m", gzip.compress(body, 1))], "url string, body binary")
    got = D.sitemap_entries(docs)
    assert tuple(got.agg(F.count("loc"), F.max("k"), F.count("lastmod"), F.count("error")).first()) == (n, n - 1, n, 0)
    assert D.sitemap_entries(docs, 10).count() == 10


def test_damaged_documents_are_rows(spark):
    docs = {"a": urlset("https://a.org/1", "https://a.org/2")[:-30], "b": gzip.compress(urlset("https://a.org/3").encode())[:-9], "c": gzip.compress(urlset("x").encode()) + gzip.compress(b"<!-- -->"), "d": None}
    rows = spark.createDataFrame([(u, x.encode() if isinstance(x, str) else x) for u, x in docs.items()], "url string, body binary")
    got = sorted((r.doc, r.kind, r.k, r.loc, r.lastmod, (r.error or "")[:7]) for r in D.sitemap_entries(rows).collect() if r.error is None)
    assert got == [("a", "urlset", 0, "https://a.org/1", "2024", ""), ("a", "urlset", 1, "https://a.org/2", None, ""), ("c", "urlset", 0, "x", "2024", "")]
    assert [(r.doc, r.error[:8]) for r in D.sitemap_entries(rows).filter("error IS NOT NULL").collect()] == [("b", "Damaged:")]


def test_damaged_feeds(spark):
    item = "<item><title>T & {0} &nbsp;</title><link>https://a.org/{0}</link><pubDate>Mon</pubDate><description><![CDATA[<b>S</b>]]></description><media:title>no</media:title></item>"
    feeds = {
        "rss": "<rss xmlns:media='m'><channel><title>C</title><item/>" + "".join(item.format(i) for i in range(3)) + "<item><title>cut</title><link>https://a.org/cut</li",
        "atom": "<a:feed xmlns:a='x'><a:entry><a:title>A</a:title><a:link rel='self' href='s'/><a:link href='https://a.org/4?a=1&b=2'/><a:published/><a:updated>2024</a:updated><a:content>c</a:content></a:entry>",
        "rdf": "<rdf:RDF><channel><item><title>no</title></item></channel><item><title>R</title><link>https://a.org/5</link><dc:date>2023</dc:date></item></rdf:RDF>",
        "guid": "<rss><channel><item><guid>https://a.org/6</guid></item><item><guid isPermaLink='false'>7</guid></item></channel></rss>",
        "html": "<html><item><link>https://a.org/8</link></item></html>",
    }
    docs = spark.createDataFrame(list(feeds.items()), "url string, body string")
    at = spark.createDataFrame([("a.org", i, u) for i, u in enumerate(feeds)], "domain string, pos int, url string")
    got = [(r.url, r.title, r.published, r.summary) for r in D.feed_entries(at, docs).orderBy("ordinal").collect()]
    assert got == [
        *((f"https://a.org/{i}", f"T & {i}", "Mon", "<b>S</b>") for i in range(3)), ("https://a.org/cut", "cut", None, ""), ("https://a.org/4?a=1&b=2", "A", "2024", "c"),
        ("https://a.org/5", "R", "2023", ""), ("https://a.org/6", "", None, ""),
    ]


def test_a_cycle_of_indexes_ends(spark):
    index = lambda *urls: f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    docs = spark.createDataFrame([("i", index("j", "s").encode()), ("j", index("i", "j").encode()), ("s", urlset("u1", "u2").encode())], "url string, body binary")
    at = spark.createDataFrame([("a.org", 0, "i")], "domain string, pos int, url string")
    got = D.sitemap_urls(at, docs)
    assert [r.url for r in got.orderBy("ordinal").collect()] == ["u1", "u2"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("kind#") and plan.count("urlset") <= 3


# ---------------------------------------------------------------- requests


def test_urls_are_quoted_and_errors_are_told():
    assert fetch.quoted(" https://a.org/a b?q=é c#f ") == "https://a.org/a%20b?q=%C3%A9%20c#f" and fetch.quoted("https://a.org/%20?x=[1]") == "https://a.org/%20?x=[1]"
    assert fetch.quoted("https://bücher.de/ü") == "https://xn--bcher-kva.de/%C3%BC"
    raised = {"cut": http.client.IncompleteRead(b"x"), "url": http.client.InvalidURL("blank"), "line": http.client.BadStatusLine("x"), "dns": OSError("no"), "value": ValueError("no")}
    calls = []

    def transport(url, agent, timeout):
        calls.append(url)
        raise raised[url[-5:].split("/")[-1]]

    client = fetch.Client(transport, delay=0, sleep=lambda seconds: None)
    for k, e in raised.items():
        assert client.ask(f"https://a.org/{k}").startswith(type(e).__name__) and client.get(f"https://a.org/{k}") is None
    assert calls.count("https://a.org/url") == 2 and calls.count("https://a.org/cut") == 8


def test_a_redirect_that_ends_in_404_is_a_redirect():
    client = fetch.Client(lambda u, a, t: Response(404, u + "/new", {}, b"", 301) if "moved" in u else Response(410, u), delay=0)
    assert fetch.status_of("https://a.org/moved", client.ask("https://a.org/moved")) == ("https://a.org/moved", 301, "https://a.org/moved/new", False, None)
    assert fetch.status_of("https://a.org/x", client.ask("https://a.org/x"))[:3] == ("https://a.org/x", 410, None)


def test_odd_charsets_are_read_as_utf8(spark):
    rows = spark.createDataFrame([(f"text/html; charset={c}", "é".encode()) for c in ("idna", "undefined", "base64", "none", "utf-8")], "kind string, body binary")
    assert [r[0] for r in rows.select(fetch.decoded(F.col("kind"), F.col("body"))).collect()] == ["é"] * 5


# ---------------------------------------------------------------- runs


def config(*domains, **settings):
    raw = {"request_delay_seconds": 0, "request_timeout_seconds": 7, "removal_threshold_runs": 1} | settings
    return read_config({"settings": raw, "competitors": [{"name": d.upper(), "domain": d} for d in domains]})


def site(domain, pages, **more):
    """Documents of a site whose sitemap lists ``pages``: url to html."""
    return {u: ("text/html", h) for u, h in pages.items()} | {f"https://www.{domain}/sitemap.xml": ("application/xml", urlset(*(u.replace("&", "&amp;") for u in pages)))} | more


def run(spark, store, conf, docs, day, transport=None):
    crawl(store, conf, datetime(2024, 1, day), transport or answers(docs), lambda seconds: None)
    return {(r.domain, r.url): r for r in store.load_state().collect()}, sorted((r.change_type, r.url) for r in store.load_changes().filter(f"run = {store.pointer()['run']}").collect())


def test_bad_urls_and_documents_cost_themselves_alone(spark, tmp_path):
    conf = config("a.org", "b.org")
    page = lambda n: PAGE.format(f"T{n}", f"Text {n}.")
    a = {f"https://a.org/{i}": page(i) for i in range(4)}
    b = {f"https://b.org/{i}": page(i) for i in range(4)}
    odd = {"https://a.org/with blank": page("blank"), "http://[bad/": "x", "https://a.org/cut": "x", "https://a.org/idna": "x"}
    docs = site("a.org", a | odd) | site("b.org", b)
    docs["https://a.org/sitemap.xml"] = ("application/gzip", gzip.compress(urlset("https://a.org/never").encode())[:-9])
    docs["https://a.org/idna"] = ("text/html; charset=idna", page("idna"))
    docs["https://a.org/1"] = ("text/html", "<![x[ " + page(1))
    plain = answers(docs)

    def transport(url, agent, timeout):
        if "bad" in url:
            raise ValueError("Invalid IPv6 URL")
        if url.endswith("/cut"):
            raise http.client.IncompleteRead(b"x")
        return plain(url, agent, timeout)

    store = Store(spark, f"file://{tmp_path}/s")
    state, _ = run(spark, store, conf, docs, 1, transport)
    assert {u for _, u in state} == {*a, *b, *odd} and all(state["b.org", u].content_hash for u in b)
    assert state["a.org", "https://a.org/idna"].title == "Tidna" and state["a.org", "https://a.org/with blank"].title == "Tblank" and state["a.org", "https://a.org/1"].title == "T1"
    errors = {(r.domain, r.stage, r.url): r for r in store.load_errors().collect()}
    assert set(errors) == {("a.org", "fetch", "http://[bad/"), ("a.org", "fetch", "https://a.org/cut"), ("a.org", "sitemap", "https://a.org/sitemap.xml")}
    assert not any(r.fatal for r in errors.values()) and all(r.run == 1 for r in errors.values())


def test_a_site_that_fails_keeps_its_state_and_the_others_go_on(spark, tmp_path):
    conf = config("a.org", "b.org", "new.org")
    deep = '<script type="application/ld+json">' + "[" * 200_000 + "</script>"
    page = lambda n, head="": f"<html><head>{head}</head>" + PAGE.format(f"T{n}", f"Text {n}.")
    a, b = ({f"https://{d}/{i}": page(i) for i in range(4)} for d in ("a.org", "b.org"))
    store = Store(spark, f"file://{tmp_path}/s")
    before, _ = run(spark, store, conf, site("a.org", a) | site("b.org", b), 1)
    broken = {"https://a.org/0": page("changed"), "https://a.org/1": page(1, deep), "https://a.org/9": page(9)}
    state, events = run(spark, store, conf, site("a.org", broken) | site("b.org", b | {"https://b.org/0": page("other")}) | site("new.org", {"https://new.org/0": page(0, deep)}), 2)
    assert {k: r for k, r in state.items() if k[0] == "a.org"} == {k: r for k, r in before.items() if k[0] == "a.org"}
    assert {u for _, u in events} == {"https://b.org/0"} and state["b.org", "https://b.org/0"].title == "Tother" and not any(d == "new.org" for d, _ in state)
    assert {(r.domain, r.stage, r.url, r.fatal) for r in store.load_errors().collect()} == {("a.org", "page", "https://a.org/1", True), ("new.org", "page", "https://new.org/0", True)}
    assert {r.domain: r.total_urls_discovered for r in store.load_sites().collect()} == {"a.org": 4, "b.org": 4, "new.org": 0}
    # Mended, the site goes on from where it was.
    state, events = run(spark, store, conf, site("a.org", a | {"https://a.org/9": page(9)}) | site("b.org", b | {"https://b.org/0": page("other")}), 3)
    assert ("new_page", "https://a.org/9") in events and not any(k == "page_removed" for k, _ in events)


def counting(docs, calls):
    """An in-process network that writes each url asked for down in a file, as tasks run in other processes."""
    plain = answers(docs)

    def transport(url, agent, timeout):
        with open(calls, "a") as f:
            f.write(json.dumps(url) + "\n")
        return plain(url, agent, timeout)

    return transport


def test_every_host_is_asked_for_its_rules_once(spark, tmp_path):
    conf = config("www.a.org", "b.org")
    page = lambda n: PAGE.format(f"T{n}", f"Text {n}.")
    blog = {"https://blog.a.org/open": page(1), "https://blog.a.org/secret": page(2)}
    docs = site("b.org", {"https://b.org/1": page(1), "https://b.org/out": page(2)})
    docs |= {u: ("text/html", h) for u, h in blog.items()} | {"https://a.org/own.xml": ("application/xml", urlset("https://a.org/1", *blog)), "https://a.org/1": ("text/html", page(3))}
    docs["https://www.a.org/robots.txt"] = ("text/plain", "Sitemap: https://a.org/own.xml\n")
    docs["https://blog.a.org/robots.txt"] = ("text/plain", "User-agent: *\nDisallow: /secret\nCrawl-delay: 3\n")
    docs["https://shop.org/robots.txt"] = ("text/plain", "User-agent: *\nDisallow: /\n")
    calls = tmp_path / "calls"

    def net(docs):
        plain = counting(docs, str(calls))

        def transport(url, agent, timeout):
            got = plain(url, agent, timeout)
            return Response(200, "https://shop.org/x", got.headers, got.body, 302) if url == "https://b.org/out" else got

        return transport

    store = Store(spark, f"file://{tmp_path}/s")
    state, _ = run(spark, store, conf, docs, 1, net(docs))
    asked = [json.loads(x) for x in calls.read_text().splitlines()]
    robots = [u for u in asked if u.endswith("/robots.txt")]
    assert len(robots) == len(set(robots)) == 6 and {"https://blog.a.org/robots.txt", "https://shop.org/robots.txt"} < set(robots)
    assert "https://blog.a.org/secret" not in asked and {u for _, u in state} == {"https://a.org/1", "https://blog.a.org/open", "https://b.org/1", "https://b.org/out"}
    assert state["b.org", "https://b.org/out"].content_hash == "" and state["www.a.org", "https://blog.a.org/open"].title == "T1"
    assert [(r.stage, r.url) for r in store.load_errors().collect()] == [("fetch", "https://b.org/out")]
    # Rules that are fresh are not asked for again; later they are.
    calls.write_text("")
    crawl(store, conf, datetime(2024, 1, 1, 5), net(docs), lambda seconds: None)
    assert not any("robots" in x for x in calls.read_text().splitlines()) and store.load_hosts().count() == 6
    docs["https://blog.a.org/robots.txt"] = ("text/plain", "User-agent: *\nDisallow: /open\n")
    crawl(store, conf, datetime(2024, 1, 1, 5) + timedelta(hours=30), net(docs), lambda seconds: None)
    assert sum("robots" in x for x in calls.read_text().splitlines()) == 6 and ("new_page", "https://blog.a.org/secret") in {(r.change_type, r.url) for r in store.load_changes().collect()}


def test_random_cuts_of_a_sitemap_never_raise():
    whole, rng = urlset(*(f"https://a.org/{i}?a=1&amp;b=é" for i in range(20))), random.Random(5)
    for _ in range(300):
        cut = list(whole)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(cut))
            cut[at : at + rng.randint(0, 9)] = rng.choice(["", "<", ">", "&", "\"", "'", "</url>", "<!--", "<![CDATA["])
        for _ in M.records(["".join(cut)], D._SITEMAPS):
            pass
