"""One run over all sites: discover, choose, read, compare, keep.

What fails, fails alone. A url that cannot be asked for, a document that cannot be inflated or a page that cannot be read becomes a
row of the run's errors. Where reading a page or a discovery document raised, the error is fatal to its site: the site keeps the
state that it had, emits nothing, and is tried again by the next run, while the other sites are committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.page import extract_or_error
from ..functions.text import netloc
from ..sources import documents as D
from ..sources.fetch import Client, Response, ask, check_status, decoded, fetched, over_network
from ..sources.hosts import Hosts
from ..sources.store import Store, total_urls
from . import changes as C
from .discovery import merge_urls, prioritize

#: Errors that a run expects of documents and handles by leaving them out, by how their text begins.
EXPECTED = "Damaged"


@dataclass
class Inputs:
    """Tables of fetched documents. ``robots``: netloc, body; ``sitemaps``: url, body, or the entries read from them; ``feeds``: url,
    content_type, body; ``items``: what was read from the feeds, where that was done before; ``captures``: domain, url, html;
    ``statuses``: URL_STATUS. The last two may be functions of the pages (domain, url) that are to be read or probed.
    ``errors``: ERRORS of what was fetched; ``hosts``: HOSTS to be kept."""

    robots: DataFrame
    sitemaps: DataFrame
    feeds: DataFrame
    captures: DataFrame | Callable[[DataFrame], DataFrame]
    statuses: DataFrame | Callable[[DataFrame], DataFrame]
    items: DataFrame | None = None
    errors: list[DataFrame] = field(default_factory=list)
    hosts: Callable[[], DataFrame] | None = None


def error_rows(rows: DataFrame, stage: str, fatal: bool | Column = False) -> DataFrame:
    """ERRORS of rows (domain, url, error)."""
    fatal = F.lit(fatal) if isinstance(fatal, bool) else fatal
    return rows.select("domain", F.lit(stage).alias("stage"), "url", "error", fatal.alias("fatal"))


def discover(sites: DataFrame, inputs: Inputs, max_urls: int, feeds_bypass_filters: bool = True, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Urls of all sites (DISCOVERED), their feed entries, and ERRORS. ``hold`` may write what was read of documents down."""

    def wanted(urls: DataFrame) -> DataFrame:
        return D.filter_patterns(D.can_fetch(urls, inputs.robots).filter("allowed").drop("allowed"), sites)

    candidates = D.sitemap_candidates(sites, inputs.robots)
    listed = inputs.sitemaps if "loc" in inputs.sitemaps.columns else hold(D.sitemap_entries(inputs.sitemaps, max_urls))
    urls = D.sitemap_urls(candidates, listed, max_urls, wanted, hold)
    feeds = D.discover_feeds(sites, inputs.feeds)
    items = inputs.items
    if items is None:
        items = hold(D.feed_items(inputs.feeds.select("url", "body").join(feeds.select("url").distinct(), "url", "left_semi")))
    entries = D.feed_entries(feeds, items)
    entries = entries if feeds_bypass_filters else wanted(entries)
    unexpected = ~F.col("error").startswith(EXPECTED)
    bad = D.sitemap_places(candidates, listed).select("domain", "doc").distinct().join(listed.filter("error IS NOT NULL").select("doc", "error"), "doc")
    errors = error_rows(bad.withColumnRenamed("doc", "url"), "sitemap", unexpected)
    bad = feeds.join(items.filter("error IS NOT NULL").select(F.col("doc").alias("url"), "error"), "url")
    return merge_urls(urls, entries), entries, errors.unionByName(error_rows(bad, "feed", unexpected))


def run_once(store: Store, config: Config, inputs: Inputs, run_ts: datetime) -> int:
    """Run and commit; returns the run's number.

    Tables that several steps read are written to the store's work folder, so a lost executor costs no second crawl.
    """
    spark, settings = store.spark, config.settings
    sites = config.site_frame(spark)
    before, at = store.load_state(), store.pointer()
    held = iter(range(10**9))
    urls, entries, errors = discover(sites, inputs, settings.max_pages_per_domain, settings.feeds_bypass_filters, lambda rows: store.work(rows, f"read-{next(held)}"))
    urls, entries = store.work(urls, "urls"), store.work(entries, "entries")
    chosen = prioritize(urls, before, entries, settings.max_hash_per_domain, at["run"] + 1).select("domain", "url")
    captures = inputs.captures(chosen) if callable(inputs.captures) else inputs.captures.join(chosen, ["domain", "url"], "left_semi")
    read = store.work(extract_or_error(captures), "extracts")
    errors = store.work(errors.unionByName(error_rows(read.filter("error IS NOT NULL"), "page", True)), "errors")
    found = read.filter("error IS NULL").drop("error")

    # Sites of the config at most.
    failed = [r[0] for r in errors.filter("fatal").select("domain").distinct().collect()]
    # Neither they nor sites that the configuration does not name any more change; their pages stay where they are written.
    named = {s["domain"] for s in config.sites}
    kept = [r["domain"] for r in store.manifest().collect() if r["domain"] in failed or r["domain"] not in named]
    still = sorted({*failed, *kept})
    works = (lambda rows: rows.filter(~F.col("domain").isin(still))) if still else (lambda rows: rows)
    prev, urls, found, entries = works(before), works(urls), works(found), works(entries)

    statuses = inputs.statuses
    if callable(statuses):
        guard = C.by_site(C.few_sites(prev, urls), C.failed_crawls(C.page_status(prev, urls)).select("domain", "crawl_failed"))
        statuses = store.work(statuses(C.due_pages(prev, urls, guard, settings.removal_threshold_runs, settings.max_missing_checks)), "statuses")
    first_run = at["run"] == 0
    if settings.first_run_scope == "site" and not first_run:
        known = [r[0] for r in prev.select("domain").distinct().join(sites, "domain", "left_semi").collect()]  # sites of the config at most
        first_run = ~F.col("domain").isin(known)
    changes, state = C.detect_changes(
        prev, urls, found, entries, statuses, sites, run_ts, first_run, settings.removal_threshold_runs, settings.max_missing_checks, lambda rows: store.work(rows, "rows")
    )
    tables = {"hosts": inputs.hosts()} if inputs.hosts is not None else {}  # adds its errors
    tables["errors"] = reduce(DataFrame.unionByName, [errors, *inputs.errors])
    run = store.save(changes, state, lambda saved: total_urls(saved, sites), run_ts, kept, **tables)
    store.prune(settings.max_changes_history)
    store.vacuum()
    store.clear_work()
    return run


def crawl(store: Store, config: Config, run_ts: datetime, transport: Callable[[str, str, float], Response] = over_network, sleep: Callable[[float], None] = time.sleep) -> int:
    """A whole run from the network: robots, sitemaps, feeds, pages, probes of missing pages, comparison, commit.

    Before urls are judged or asked for, the rules of all their hosts are known; each host is asked for them once, and not at all
    while an earlier run's answer is fresh.
    """
    spark, settings = store.spark, config.settings
    sites = config.site_frame(spark)
    timeout = settings.request_timeout_seconds

    def client() -> Client:
        return Client(transport, settings.request_delay_seconds, timeout, sleep=sleep)

    hosts = Hosts(store.load_hosts(), client, settings.request_delay_seconds, run_ts, store.work)
    errors: list[DataFrame] = []

    def asked(urls: DataFrame, name: str) -> DataFrame:
        hosts.meet(urls)
        return store.work(ask(hosts.polite(urls), client), name)

    def failures(got: DataFrame, stage: str, of: DataFrame) -> None:
        """Errors of documents that there should be: a place where none is found is no error."""
        bad = got.filter("error IS NOT NULL AND (status_code IS NULL OR status_code >= 500)").select("url", "error")
        errors.append(error_rows(bad.join(of.select("domain", "url").distinct(), "url"), stage))

    bare = D.bare_host(F.col("domain"))
    hosts.meet(sites.select(F.explode(F.array(F.concat(F.lit("https://www."), bare), F.concat(F.lit("https://"), bare))).alias("url")))

    # A level of sitemaps at a time; each is asked for once.
    candidates = D.sitemap_candidates(sites, hosts.robots)
    level, listed, known = candidates.select("url").distinct(), None, None
    for depth in range(D.MAX_DEPTH + 1):
        got = asked(level, f"sitemaps-{depth}")
        read = store.work(D.sitemap_entries(fetched(got).select("url", "body"), settings.max_pages_per_domain), f"listed-{depth}")
        listed = read if listed is None else listed.unionByName(read)
        known = got if known is None else known.unionByName(got)
        level = read.filter("kind = 'sitemapindex'").select(F.col("loc").alias("url")).distinct().join(known.select("url"), "url", "left_anti")
    failures(known, "sitemap", D.sitemap_places(candidates, listed).withColumnRenamed("doc", "url"))
    hosts.meet(listed.filter("kind = 'urlset'").select(F.col("loc").alias("url")))

    places = D.feed_places(sites)
    got = asked(places.select("url").distinct(), "feeds-asked")
    failures(got, "feed", places)
    feeds = fetched(got).select("url", "content_type", decoded(F.col("content_type"), F.col("body")).alias("body"))
    feeds = store.work(feeds, "feeds")
    items = store.work(D.feed_items(feeds.join(D.discover_feeds(sites, feeds).select("url").distinct(), "url", "left_semi")), "items")
    hosts.meet(items.select("url"))

    def captures(chosen: DataFrame) -> DataFrame:
        chosen = store.work(chosen, "chosen")
        got = asked(chosen.select("url").distinct(), "pages")
        pages = fetched(got)
        moved = pages.filter(netloc(F.col("final_url")) != netloc(F.col("url"))).select("url", F.col("final_url"))
        hosts.meet(moved.select(F.col("final_url").alias("url")))
        refused = D.can_fetch(moved.select(F.col("url").alias("asked"), F.col("final_url").alias("url")), hosts.robots).filter("NOT allowed").select(F.col("asked").alias("url"))
        bad = got.filter("error IS NOT NULL").select("url", "error").unionByName(refused.withColumn("error", F.lit("led to a url that robots rules forbid")))
        errors.append(error_rows(chosen.join(bad, "url"), "fetch"))
        pages = pages.join(refused, "url", "left_anti")
        if settings.html_only:
            pages = pages.filter(F.lower("content_type").contains("html"))
        pages = pages.select("url", decoded(F.col("content_type"), F.col("body")).alias("html"))
        return store.work(chosen.join(pages, "url").select("domain", "url", "html"), "captures")

    def statuses(due: DataFrame) -> DataFrame:
        due = store.work(due.select("url"), "due")
        hosts.meet(due)
        return check_status(hosts.polite(due), client)

    def known_hosts() -> DataFrame:
        own = sites.select("domain", bare.alias("_bare"))
        bad = [e.filter("status_code IS NULL OR status_code >= 500").withColumn("_bare", D.bare_host(F.col("netloc"))).join(own, "_bare", "left") for e in hosts.errors]
        errors.extend(error_rows(e, "robots") for e in bad)
        return hosts.robots

    return run_once(store, config, Inputs(hosts.robots, listed, feeds, captures, statuses, items, errors, known_hosts), run_ts)


def run_summary(changes: DataFrame, sites: DataFrame) -> DataFrame:
    """Events of a run by site."""
    n = changes.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return sites.join(n, "domain", "left").select("domain", "name", F.coalesce("n", F.lit(0)).alias("n_changes"))
