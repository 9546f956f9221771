"""Changes over many snapshots in one pass.

Run after run, detection is a full outer join of the state with the crawl, k times over a history of k runs. Here a page's crawls
are one window: ``lag`` tells when it was last seen, a running count of its beginnings tells its lives apart, and ``last`` over a
life carries what was read of it. A gap between two crawls is an island of missing runs; the page is removed in the run in which
that island reaches the threshold, if it does.

What a run may remove depends on its site: where more than half of the pages known are missing, the crawl counts as failed,
removes nothing and does not count towards the threshold. Whether that is so depends on the removals before. It is solved from
counts alone: how many pages of a site were last seen in run s and next in run n says, for each run, how many are known and how
many missing, once the runs before are judged. A site has at most k * k / 2 such counts, and they are folded run by run.

Defined results: as ``detect_changes`` run by run, the first run being the baseline. Runs are numbered from 1 without gaps; a site
without urls in a run has all its pages missing in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import changes as C

KEY = ("domain", "url")


def _seen(urls: DataFrame, extracts: DataFrame, feeds: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each page of each crawl: run, run_ts, domain, url, u, h, f, with ``before`` and ``after``, the runs it is seen in next to this."""
    wrap = lambda df, name: df.select("run", *KEY, F.struct(*[c for c in df.columns if c not in ("run", *KEY)], F.lit(True).alias("here")).alias(name))
    u = wrap(C.one_row_each(urls.select("run", "domain", "url", "lastmod", "title"), "run", *KEY), "u")
    rows = u.join(wrap(extracts, "h"), ["run", *KEY], "left").join(wrap(C.one_row_each(feeds, "run", *KEY), "f"), ["run", *KEY], "left")
    page = W.partitionBy(*KEY).orderBy("run")
    return rows.join(F.broadcast(runs), "run").withColumns({"before": F.lag("run").over(page), "after": F.lead("run").over(page)})


def guarded_runs(seen: DataFrame, n_runs: int, threshold: int) -> DataFrame:
    """(domain, good): for each site an array by run, from 0, of how many runs up to it did not count as failed crawls."""
    ends = F.coalesce("after", F.lit(n_runs + 1))
    counts = seen.groupBy("domain", F.col("run").alias("s"), ends.alias("e")).agg(F.count(F.lit(1)).alias("n"))
    per_site = counts.groupBy("domain").agg(F.collect_list(F.struct("s", "e", "n")).alias("c"))

    def judged(good: Column, run: Column) -> Column:
        known = F.filter("c", lambda x: (x["s"] < run) & (run <= x["e"]) & (good[run - 1] - good[x["s"]] < threshold))
        total = lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
        missing = total(F.filter(known, lambda x: run < x["e"]))
        return F.concat(good, F.array(good[run - 1] + F.when(2 * missing > total(known), 0).otherwise(1)))

    good = F.aggregate(F.sequence(F.lit(1), F.lit(n_runs)), F.array(F.lit(0)), judged)
    return per_site.select("domain", good.alias("good"))


def history_changes(
    runs: DataFrame,
    urls: DataFrame,
    extracts: DataFrame,
    feeds: DataFrame,
    statuses: DataFrame,
    sites: DataFrame,
    threshold: int = 2,
    max_probes: int = 50,
    hold: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[DataFrame, DataFrame]:
    """(run and CHANGES of all runs, PAGE_STATE after the last).

    ``runs``: RUNS, a row for each, broadcast; the other tables are those of ``detect_changes``, with their run. ``hold`` may write
    what is read more than once down.
    """
    n_runs = runs.count()
    few = C.few_sites(urls, sites)
    seen = hold(_seen(urls, extracts, feeds, runs))
    good = C.by_site(few, guarded_runs(seen, n_runs, threshold))
    rows = seen.join(good, "domain")
    # A page that was missing for too long is a new one.
    known = F.col("before").isNotNull() & (F.element_at("good", F.col("run")) - F.element_at("good", F.col("before") + 1) < threshold)
    rows = rows.withColumn("status", F.when(known, "existing").otherwise("new"))
    page = W.partitionBy(*KEY).orderBy("run")
    rows = rows.withColumn("life", F.count_if(F.col("status") == "new").over(page))
    life = W.partitionBy(*KEY, "life").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    h, u, new = (lambda n: F.col(f"h.{n}")), (lambda n: F.col(f"u.{n}")), F.col("status") == "new"
    read = F.col("h").isNotNull()

    def carried(name: str, absent: Column) -> Column:
        return F.coalesce(F.last(F.when(read, F.coalesce(h(name), absent)), ignorenulls=True).over(life), absent).alias(name)

    latest = lambda value: F.last(value, ignorenulls=True).over(life)
    text, lists = F.lit(""), F.array().cast("array<string>")
    title = F.when(T.truthy(h("title")), h("title")).when(new, F.coalesce(u("title"), text))
    after = F.struct(
        F.first("run_ts").over(life).alias("first_seen"), F.col("run_ts").alias("last_seen"), carried("content_hash", text), latest(title).alias("title"),
        F.coalesce(latest(F.when(T.truthy(h("meta_description")), h("meta_description"))), text).alias("meta_description"), carried("content_snippet", text),
        carried("h1_tags", lists), carried("word_count", F.lit(0)), carried("canonical", text), carried("schemas", lists),
        latest(F.when(new, u("lastmod")).otherwise(F.nullif(u("lastmod"), text))).alias("lastmod_from_sitemap"),
    )
    rows = hold(rows.withColumn("state", after).withColumn("p", F.when(~new, F.lag("state").over(page))))

    none = F.lit(None)
    s_type = "struct<status_code:int,redirect_to:string,noindex:boolean,here:boolean>"
    judged = {"first_run": F.col("run") == 1, "due": F.lit(False), "missing_runs": F.lit(0), "s": none.cast(s_type)}
    columns = ["run", "run_ts", *KEY, "status", "first_run", "due", "missing_runs", "p", "u", "h", "f", "s"]
    crawled = rows.withColumns(judged).select(*columns)

    # The run in which the island after a crawl reaches the threshold.
    at = F.array_position(F.transform("good", lambda g: g - F.element_at("good", F.col("run") + 1)), F.lit(threshold)).cast("int") - 1
    gone = rows.withColumn("gone", at).filter((F.col("gone") > F.col("run")) & (F.col("gone") < F.coalesce("after", F.lit(n_runs + 1))))
    gone = gone.select(F.col("gone").alias("run"), *KEY, F.col("state").alias("p"))
    place = F.row_number().over(W.partitionBy("run", "domain").orderBy("url"))
    probed = gone.select("run", *KEY, place.alias("k")).filter(F.col("k") <= max_probes).drop("k")
    found = C.one_row_each(statuses.select("run", "url", "status_code", "redirect_to", "noindex"), "run", "url")
    found = found.select("run", "url", F.struct("status_code", "redirect_to", "noindex", F.lit(True).alias("here")).alias("s"))
    gone = gone.join(probed.join(found, ["run", "url"]), ["run", *KEY], "left").join(F.broadcast(runs), "run")
    empty = lambda name: none.cast(crawled.schema[name].dataType).alias(name)
    removed = gone.select(
        "run", "run_ts", *KEY, F.lit("missing").alias("status"), F.lit(False).alias("first_run"), F.lit(True).alias("due"), F.lit(threshold).alias("missing_runs"), "p",
        empty("u"), empty("h"), empty("f"), "s",
    )
    events = C.page_events(C.with_diffs(crawled.unionByName(removed)), F.col("run_ts"))

    # Urls that begin while one that differs from them in case is missing: one island of a site and key meets a beginning in it.
    until = F.when(F.col("gone") > F.col("run"), F.least("gone", "end")).otherwise(F.col("end"))
    island = rows.withColumns({"gone": at, "end": F.coalesce(F.col("after") - 1, F.lit(n_runs))})
    island = island.select("domain", F.col("url").alias("old_url"), T.match_key(F.col("url")).alias("k"), F.col("run").alias("_from"), until.alias("_to"), F.col("state.title").alias("title"))
    begins = rows.filter(new & (F.col("run") > 1)).select("domain", "run", "run_ts", F.col("url").alias("new_url"), T.match_key(F.col("url")).alias("k"))
    pairs = island.filter("_to > _from").join(begins, ["domain", "k"]).filter("run > _from AND run <= _to")
    pairs = pairs.filter(T.bare(F.col("old_url")) != T.bare(F.col("new_url")))
    events = C.named(events.unionByName(C.case_events(pairs, F.col("run_ts"))), sites, few)
    events = events.join(F.broadcast(runs.select("run", F.col("run_ts").alias("timestamp"))), "timestamp").select("run", *events.columns)

    count = F.element_at("good", F.lit(n_runs + 1)) - F.element_at("good", F.col("run") + 1)
    missing = F.when(F.col("run") == n_runs, 0).otherwise(count).cast("int")
    state = rows.filter(F.col("after").isNull()).withColumn("consecutive_missing", missing).filter(F.col("consecutive_missing") < threshold)
    return events, state.select(*KEY, "state.*", "consecutive_missing")
