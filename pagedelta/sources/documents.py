"""Discovery documents held in tables: robots rules, sitemaps, feeds.

Inputs are tables of fetched documents, so that everything here is a plan; fetching is ``sources.fetch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from typing import Any
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import has_any, netloc
from . import markup as M

MAX_DEPTH = 3
MAX_ENTRIES = 50
SUMMARY_CHARS = 200

# Where feeds are looked for, in order.
FEED_PATHS = (
    "/feed", "/feed/", "/rss", "/rss.xml", "/blog/feed", "/blog/feed/", "/blog/rss.xml", "/feed.xml", "/atom.xml", "/blog/atom.xml",
    "/resources/feed",
)

# ---------------------------------------------------------------- robots


@lru_cache(maxsize=10_000)
def _rules(body: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    return parser


def _read_robots(body: pd.Series) -> pd.DataFrame:
    got = [_rules(text) if text else None for text in body]
    return pd.DataFrame({
        "crawl_delay": pd.array([r.crawl_delay("*") if r else None for r in got], "Int32"),
        "sitemaps": [(r.site_maps() or []) if r else [] for r in got],
    })


def robots_rules(robots: DataFrame) -> DataFrame:
    """netloc, crawl_delay (whole seconds for any agent, or null), sitemaps, body of each robots document (netloc, body)."""
    read = F.pandas_udf(_read_robots, "struct<crawl_delay:int,sitemaps:array<string>>")
    return robots.select("netloc", read("body").alias("r"), "body").select("netloc", "r.crawl_delay", "r.sitemaps", "body")


def _allowed(body: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([not text or u is None or _rules(text).can_fetch("*", u) for text, u in zip(body, url, strict=True)])


def can_fetch(urls: DataFrame, robots: DataFrame, to: str = "allowed") -> DataFrame:
    """``urls`` with whether their host's rules allow them; a host without rules allows all. First matching rule wins."""
    rules = robots.select(F.col("netloc").alias("_netloc"), F.col("body").alias("_rules"))
    rules = rules.groupBy("_netloc").agg(F.first("_rules").alias("_rules"))
    got = urls.withColumn("_netloc", netloc(F.col("url"))).join(rules, "_netloc", "left")
    return got.withColumn(to, F.pandas_udf(_allowed, "boolean")("_rules", "url")).drop("_netloc", "_rules")


def with_delay(urls: DataFrame, robots: DataFrame, default: float) -> DataFrame:
    """``urls`` with the seconds between requests to their host: the larger of the setting and the host's own wish."""
    own = robots_rules(robots).groupBy(F.col("netloc").alias("_netloc")).agg(F.max("crawl_delay").alias("_delay"))
    got = urls.withColumn("_netloc", netloc(F.col("url"))).join(own, "_netloc", "left")
    return got.withColumn("delay", F.greatest(F.lit(float(default)), F.coalesce(F.col("_delay").cast("double"), F.lit(0.0)))).drop("_netloc", "_delay")


# ---------------------------------------------------------------- sitemaps


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def sitemap_candidates(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(domain, pos, url): configured sitemaps, then those that robots names, then the usual places; each once."""
    d = bare_host(F.col("domain"))
    usual = F.array(
        F.concat(F.lit("https://www."), d, F.lit("/sitemap.xml")),
        F.concat(F.lit("https://www."), d, F.lit("/sitemap_index.xml")),
        F.concat(F.lit("https://"), d, F.lit("/sitemap.xml")),
    )
    host = F.struct(~F.col("netloc").startswith("www."), "netloc")  # the www host's first
    named = robots_rules(robots).select(bare_host(F.col("netloc")).alias("_bare"), F.struct(host.alias("host"), F.col("sitemaps").alias("own")).alias("s"))
    named = named.groupBy("_bare").agg(F.array_sort(F.collect_list("s")).alias("s")).select("_bare", F.flatten("s.own").alias("named"))
    empty = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("sitemaps", empty), F.coalesce("named", empty), usual))
    return sites.withColumn("_bare", d).join(named, "_bare", "left").select("domain", F.posexplode(every).alias("pos", "url"))


_SITEMAPS = {"urlset": ((), "url", frozenset({"loc", "lastmod", "changefreq", "priority"})), "sitemapindex": ((), "sitemap", frozenset({"loc", "lastmod"}))}
SITEMAP_ENTRY = "doc string, kind string, k bigint, loc string, lastmod string, error string"
#: Rows that a task hands on at a time.
ROWS = 1000


def _rows(read: Callable[[str, Any], Iterator[tuple]], names: list[str], types: list[pa.DataType]) -> Callable:
    """A reader of documents (url, body) that passes rows on as it finds them; one that fails gives a last row with its error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for documents in batches:
            for url, body in zip(documents.column(0).to_pylist(), documents.column(1), strict=True):
                if not body.is_valid:
                    continue
                try:
                    for row in read(url, body.as_py()):
                        held.append((*row, None))
                        if len(held) >= ROWS:
                            yield batch()
                            held.clear()
                except Exception as e:  # one document must not fail the others; the error is a row
                    held.append((url, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:500]))
        if held:
            yield batch()

    return work


def sitemap_entries(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """SITEMAP_ENTRY: the first ``limit`` entries with a url of each document (url, body binary, gzipped or not), in order.

    ``kind`` is the root, urlset or sitemapindex; other documents have no entries. A gzipped document that cannot be inflated whole
    has no entries and a row with its error; other damage costs what it hides.
    """

    def read(url: str, body: bytes) -> Iterator[tuple]:
        first = lambda record, name: next((t for t, _ in record.get(name, ())), "")
        entries = ((kind, first(e, "loc"), first(e, "lastmod")) for kind, e in M.records(M.decoded_text(M.inflated(body)), _SITEMAPS))
        for k, (kind, loc, lastmod) in enumerate(islice((e for e in entries if e[1]), limit)):
            yield url, kind, k, loc, lastmod or None

    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return documents.select("url", F.col("body").cast("binary")).mapInArrow(_rows(read, [c.split()[0] for c in SITEMAP_ENTRY.split(", ")], types), SITEMAP_ENTRY)


def sitemap_places(candidates: DataFrame, entries: DataFrame, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(domain, doc, path): where each document stands, as candidate or below indexes, to ``MAX_DEPTH`` levels, so that a cycle ends.

    The levels read the entries of indexes alone; ``hold`` may write each down, and then the search ends with the last that has any.
    """
    edges = entries.filter("kind = 'sitemapindex'").select("doc", "k", "loc")
    level = candidates.select("domain", F.col("url").alias("doc"), F.array(F.col("pos").cast("bigint")).alias("path"))
    places = level
    for _ in range(MAX_DEPTH):
        level = level.join(edges, "doc").select("domain", F.col("loc").alias("doc"), F.concat("path", F.array("k")).alias("path"))
        if hold:
            level = hold(level)
            if level.isEmpty():
                break
        places = places.unionByName(level)
    return places


def sitemap_urls(candidates: DataFrame, documents: DataFrame, max_urls: int = 10_000, wanted: Callable[[DataFrame], DataFrame] | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(domain, url, lastmod, ordinal) of the urls that the candidates and their children list, first mention first.

    ``documents`` as for ``sitemap_entries``, or its result; one join reads the entries of all places. A candidate and its children
    give ``max_urls`` entries at most, wanted or not; ``wanted`` filters what is left, and of that a domain keeps ``max_urls``.
    ``hold`` may write down what is read more than once.
    """
    entries = documents
    if "loc" not in documents.columns:
        entries = sitemap_entries(documents, max_urls)
        entries = hold(entries) if hold else entries
    places = sitemap_places(candidates, entries, hold)
    rows = places.join(entries.filter("kind = 'urlset'"), "doc").select("domain", F.col("loc").alias("url"), "lastmod", F.concat("path", F.array("k")).alias("path"))
    entry = F.row_number().over(W.partitionBy("domain", F.get("path", 0)).orderBy("path"))
    rows = rows.withColumn("entry", entry).filter(F.col("entry") <= max_urls).drop("entry")
    # A url's first mention is an aggregate, so a url that many documents list does not gather anywhere.
    first = rows.groupBy("domain", "url").agg(F.min("path").alias("path"), F.min_by("lastmod", "path").alias("lastmod"))
    first = wanted(first) if wanted else first
    order = F.row_number().over(W.partitionBy("domain").orderBy("path"))
    return first.withColumn("ordinal", order.cast("bigint")).filter(F.col("ordinal") <= max_urls).select("domain", "url", "lastmod", "ordinal")


def filter_patterns(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Urls that contain an include pattern, if their site has any, and no exclude pattern."""
    own = sites.select("domain", F.col("include_patterns").alias("_in"), F.col("exclude_patterns").alias("_ex"))
    got = urls.join(own, "domain", "left")
    wanted = (F.coalesce(F.size("_in"), F.lit(0)) == 0) | has_any(F.col("url"), F.col("_in"))
    refused = (F.coalesce(F.size("_ex"), F.lit(0)) > 0) & has_any(F.col("url"), F.col("_ex"))
    return got.filter(wanted & ~refused).drop("_in", "_ex")


# ---------------------------------------------------------------- feeds


def looks_like_feed(content_type: Column, body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 500))
    typed = [F.contains(content_type, F.lit(x)) for x in ("xml", "rss", "atom", "feed")]
    tagged = [F.contains(head, F.lit(x)) for x in ("<rss", "<feed", "<atom")]
    out = F.lit(False)
    for test in [*typed, *tagged]:
        out = out | F.coalesce(test, F.lit(False))
    return out


def feed_places(sites: DataFrame) -> DataFrame:
    """(domain, pos, url, own): the configured feeds in their order, or the usual places where a site has none."""
    own = F.coalesce(F.size("feeds"), F.lit(0)) > 0
    usual = F.transform(F.array(*(F.lit(p) for p in FEED_PATHS)), lambda p: F.concat(F.lit("https://www."), bare_host(F.col("domain")), p))
    return sites.withColumn("_own", own).select("domain", F.posexplode(F.when(own, F.col("feeds")).otherwise(usual)).alias("pos", "url"), F.col("_own").alias("own"))


def discover_feeds(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """(domain, pos, url): the configured feeds, else the first usual place whose document (url, content_type, body) is one."""
    places = feed_places(sites)
    good = places.filter(~F.col("own")).join(documents.filter(looks_like_feed(F.col("content_type"), F.col("body"))), "url")
    found = good.groupBy("domain").agg(F.lit(0).alias("pos"), F.min_by("url", "pos").alias("url"))
    return places.filter("own").select("domain", "pos", "url").unionByName(found)


_FIELDS = frozenset({"title", "link", "pubdate", "*published", "*updated", "*date", "description", "summary", "content", "*encoded", "guid"})
_FEEDS = {"rss": (("channel",), "item", _FIELDS), "rdf": ((), "item", _FIELDS), "feed": ((), "entry", _FIELDS)}
FEED_ITEM = "doc string, k bigint, url string, title string, published string, summary string, error string"


def _feed_item(record: dict) -> tuple[str, str, str | None, str]:
    """Link, title, time and summary of an item of any of the formats."""

    def text(*names: str) -> str:
        return next((t for n in names for t, _ in record.get(n, ()) if t), "")

    links = [a for _, a in record.get("link", ()) if a.get("href")]
    href = next((a["href"] for a in [*(x for x in links if x.get("rel", "alternate") == "alternate"), *links]), "")
    own = next((t for t, a in record.get("guid", ()) if a.get("ispermalink", "true").lower() != "false"), "")
    return (text("link") or href or own).strip(), text("title"), text("pubdate", "published", "updated", "date") or None, text("description", "summary", "content", "encoded")


def feed_items(documents: DataFrame) -> DataFrame:
    """FEED_ITEM: the first ``MAX_ENTRIES`` items of each document (url, body string) that is RSS, RDF or Atom, damaged or not."""

    def read(url: str, body: str) -> Iterator[tuple]:
        pieces = (body[i : i + M.CHUNK] for i in range(0, len(body), M.CHUNK))
        for k, (_, record) in enumerate(islice(M.records(pieces, _FEEDS), MAX_ENTRIES)):
            yield url, k, *_feed_item(record)

    types = [pa.string(), pa.int64(), *[pa.string()] * 5]
    return documents.select("url", "body").mapInArrow(_rows(read, [c.split()[0] for c in FEED_ITEM.split(", ")], types), FEED_ITEM)


def feed_entries(feeds: DataFrame, documents: DataFrame) -> DataFrame:
    """(domain, url, title, published, summary, ordinal): the first ``MAX_ENTRIES`` entries of each feed, each url once, where it
    stands first in the order of the feeds. ``documents``: url and body, or the result of ``feed_items``."""
    items = documents if "doc" in documents.columns else feed_items(documents.select("url", "body").join(feeds.select("url").distinct(), "url", "left_semi"))
    rows = feeds.select("domain", F.col("pos").cast("bigint").alias("pos"), F.col("url").alias("doc")).join(items.filter("error IS NULL"), "doc")
    rows = rows.select("domain", (F.col("pos") * MAX_ENTRIES + F.col("k")).alias("ordinal"), "url", "title", "published", "summary")
    rows = rows.filter(F.coalesce("url", F.lit("")) != "")
    text = F.coalesce("summary", F.lit(""))
    short = F.when(F.length(text) > SUMMARY_CHARS, F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit("..."))).otherwise(text)
    return rows.groupBy("domain", "url").agg(
        F.min_by(F.coalesce("title", F.lit("")), "ordinal").alias("title"), F.min_by("published", "ordinal").alias("published"),
        F.min_by(short, "ordinal").alias("summary"), F.min("ordinal").alias("ordinal"),
    )
