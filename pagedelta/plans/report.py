"""Queries over the changelog: filters, counts, trends, tables, pages and exports.

``log``: seq, ts, domain, url, change_type (more columns may follow). ``as_of`` stands for now and is always a parameter.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import week_key

PAGE = 50
H1_SHOWN = 50


def since(log: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Events of the last ``days`` days; 0 for all."""
    return log.filter(F.col("ts") >= F.lit(as_of - timedelta(days=days))) if days else log


def between(log: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Events of whole days, both included; either may be open."""
    if start:
        log = log.filter(F.col("ts") >= F.lit(datetime(start.year, start.month, start.day)))
    if end:
        log = log.filter(F.col("ts") < F.lit(datetime(end.year, end.month, end.day) + timedelta(days=1)))
    return log


def matching(log: DataFrame, domain: str = "", change_type: str = "") -> DataFrame:
    """Events of a site and a type; blank for any."""
    if domain:
        log = log.filter(F.col("domain") == domain)
    if change_type:
        log = log.filter(F.col("change_type") == change_type)
    return log


def of_type(*kinds: str) -> Column:
    return F.count_if(F.col("change_type").isin(*kinds)).cast("bigint")


def global_stats(log: DataFrame, sites: DataFrame) -> DataFrame:
    own = sites.select(F.lit(1).alias("site"), F.col("total_pages").alias("pages"), F.lit(None).cast("string").alias("change_type"))
    rows = own.unionByName(log.select(F.lit(0).alias("site"), F.lit(0).alias("pages"), "change_type"))
    return rows.agg(
        F.coalesce(F.sum("site"), F.lit(0)).cast("bigint").alias("n_sites"), F.coalesce(F.sum("pages"), F.lit(0)).cast("bigint").alias("total_pages"),
        of_type("new_page").alias("n_new"), of_type("content_update").alias("n_updates"), F.count_if(F.col("site") == 0).cast("bigint").alias("n_total"),
    )


def site_cards(log: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site with its pages, events, and its pages as a share of the largest site's."""
    n = log.groupBy("domain").agg(of_type("new_page").alias("n_new"), of_type("content_update").alias("n_updates"), F.count(F.lit(1)).alias("n_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    top = F.greatest(F.max("total_pages").over(W.partitionBy()), F.lit(1))  # one row for each site
    got = sites.withColumn("top", top).join(n, "domain", "left")
    return got.select(
        "domain", "name", F.col("total_pages").cast("bigint").alias("total_pages"), zero("n_new"), zero("n_updates"), zero("n_total"),
        (100.0 * F.col("total_pages") / F.col("top")).alias("bar_pct"),
    )


def activity_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("n_total"), of_type("new_page").alias("n_new"), of_type("content_update").alias("n_updates"),
        of_type("redirect").alias("n_redirects"), of_type("page_removed").alias("n_removed"),
    )


def type_breakdown(log: DataFrame) -> DataFrame:
    """Types by count, with shares of the largest and of all; ties by first appearance."""
    n = log.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    every = W.partitionBy()  # one row for each type, nine at most
    return n.select(
        "change_type", "n", "first_seq", (100.0 * F.col("n") / F.max("n").over(every)).alias("pct_of_max"), (100.0 * F.col("n") / F.sum("n").over(every)).alias("pct_of_total")
    ).orderBy(F.col("n").desc(), "first_seq")


def weekly_trend(log: DataFrame, weeks: int = 12) -> DataFrame:
    """The last weeks, from Sunday, with new pages, updates and the rest; nothing if there are fewer than two."""
    n = log.groupBy(week_key(F.col("ts")).alias("week")).agg(
        of_type("new_page").alias("n_new"), of_type("content_update").alias("n_updates"), F.count(F.lit(1)).alias("n_total")
    )
    last = n.orderBy(F.col("week").desc()).limit(weeks)
    many = last.withColumn("_weeks", F.count(F.lit(1)).over(W.partitionBy())).filter("_weeks >= 2").drop("_weeks")
    return many.withColumn("n_other", F.col("n_total") - F.col("n_new") - F.col("n_updates")).orderBy("week")


def site_chart(log: DataFrame, sites: DataFrame, change_type: str = "") -> DataFrame:
    """Listed sites by events, as a share of the most active domain of the whole log, listed or not."""
    n = matching(log, change_type=change_type).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("share", 100.0 * F.col("n") / F.max("n").over(W.partitionBy()))  # one row for each domain
    got = sites.select("domain", "name").join(n, "domain", "left")
    return got.select("domain", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("share", F.lit(0.0)).alias("pct_of_max"))


def _weekly(log: DataFrame) -> DataFrame:
    return log.groupBy("domain", week_key(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


def sparklines(log: DataFrame, weeks: int = 4) -> DataFrame:
    """A site's last weeks that have events, oldest first; sites with one such week have none."""
    k = F.row_number().over(W.partitionBy("domain").orderBy(F.col("week").desc()))
    last = _weekly(log).withColumn("k", k).filter(F.col("k") <= weeks)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("week", "n"))), lambda x: x["n"].cast("string")), " → ")
    return last.groupBy("domain").agg(F.count(F.lit(1)).alias("n_weeks"), line.alias("line")).filter("n_weeks > 1")


def last_weeks(log: DataFrame, weeks: int = 6) -> list[date]:
    got = log.select(week_key(F.col("ts")).alias("week")).distinct().orderBy(F.col("week").desc()).limit(weeks).collect()
    return sorted(r["week"] for r in got)


def week_table(log: DataFrame, weeks: int = 6) -> DataFrame:
    """Events by site and week, zero where there are none, in columns named by week; empty for a single week."""
    columns = last_weeks(log, weeks)
    shown = _weekly(log).withColumn("week", F.col("week").cast("string")) if len(columns) > 1 else _weekly(log).filter("false")
    return shown.groupBy("domain").pivot("week", [str(c) for c in columns]).sum("n").fillna(0)


def week_table_long(log: DataFrame, weeks: int = 6) -> DataFrame:
    """The week table with a row for each cell."""
    last = F.array(*(F.lit(w) for w in last_weeks(log, weeks))).cast("array<date>")
    cells = log.select("domain").distinct().select("domain", F.explode(last).alias("week"))
    n = _weekly(log)
    return cells.join(n, ["domain", "week"], "left").select("domain", "week", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.col("ts").desc(), "seq").limit(n)


def page(log: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of the log, newest first; the first is 1."""
    return log.orderBy(F.col("ts").desc(), "seq").offset(size * (number - 1)).limit(size)


def page_window(n_rows: Column, number: Column, size: int = PAGE, around: int = 2) -> Column:
    """How many pages there are, and which of them are offered beside this one; none where one page holds all."""
    pages = F.ceil(n_rows / size).cast("int")
    offered = F.sequence(F.greatest(number - around, F.lit(1)), F.greatest(F.least(number + around, pages), F.lit(1)))
    return F.struct(pages.alias("pages"), F.when(pages > 1, offered).otherwise(F.array().cast("array<int>")).alias("offered"))


def export_changes(changes: DataFrame) -> DataFrame:
    """Events (CHANGES) flattened to the columns of the export; blank where a type lacks a value."""
    d = lambda name: F.col(f"details.{name}")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    count = lambda *names: F.coalesce(*(F.nullif(d(n), F.lit(0)).cast("string") for n in names), F.lit(""))
    joined = lambda x, by: F.coalesce(F.array_join(x, by), F.lit(""))
    return changes.select(
        F.col("timestamp").alias("Date"), F.col("competitor").alias("Competitor"), F.col("domain").alias("Domain"), F.col("change_type").alias("Change Type"),
        text(F.col("title")).alias("Title"), F.col("url").alias("URL"), text(d("diff_summary")).alias("Diff Summary"),
        text(d("old_title")).alias("Old Title"), text(d("new_title")).alias("New Title"), text(d("old_meta")).alias("Old Meta"),
        text(d("new_meta")).alias("New Meta"), text(d("old_h1")).alias("Old H1"), text(d("new_h1")).alias("New H1"),
        count("new_word_count", "word_count").alias("Word Count"), count("word_count_change").alias("Word Count Change"),
        joined(F.coalesce(d("schemas"), d("added_schemas")), ", ").alias("Schemas"), text(F.col("details.redirect.redirect_to")).alias("Redirect To"),
        F.when(d("noindex"), "Yes").otherwise("").alias("Noindex"), joined(d("added"), " | ").alias("Added Content"), joined(d("removed"), " | ").alias("Removed Content"),
    )


def export_summary(log: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites with their totals over the whole log."""
    n = log.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_changes"), of_type("new_page").alias("new_pages"), of_type("content_update").alias("content_updates"),
        of_type("redirect").alias("redirects"), of_type("page_removed").alias("removed"),
    )
    names = ("total_changes", "new_pages", "content_updates", "redirects", "removed")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names]
    return sites.join(n, "domain", "left").select("domain", F.col("name").alias("competitor"), F.col("total_pages").cast("bigint").alias("total_pages"), *zero)


def detail_line(changes: DataFrame) -> DataFrame:
    """Events with what a reader is told of them: the parts of ``line``, joined by a dot, and the tags."""
    d = lambda name: F.col(f"details.{name}")
    some = lambda x: F.coalesce(x.cast("string"), F.lit("")) != ""
    number = lambda x: F.coalesce(x, F.lit(0)) != 0
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    told = lambda when, *parts: F.when(when, text(*parts))
    pair = lambda a, b, before="", quote="": told(some(d(a)) & some(d(b)), f"{before}{quote}", d(a), f"{quote} → {quote}", d(b), quote)
    moved = F.col("details.redirect").isNotNull()
    line = [
        told(some(d("summary")) & (F.col("change_type") == "new_page"), d("summary")), told(some(d("published_date")), "Published: ", d("published_date")),
        told(some(d("diff_summary")), d("diff_summary")), pair("old_title", "new_title", quote='"'), pair("old_meta", "new_meta", quote='"'), pair("old_h1", "new_h1", "H1: ", '"'),
        told(moved, d("redirect.status_code").cast("string"), " → ", d("redirect.redirect_to")), told(F.coalesce(d("noindex"), F.lit(False)), "NOINDEX"), pair("old_url", "new_url"),
        told(number(d("missing_runs")) & ~moved, "Missing ", d("missing_runs").cast("string"), " runs"),
    ]
    change = d("word_count_change")
    many = lambda name, sign: F.transform(F.coalesce(d(name), F.array().cast("array<string>")), lambda s: F.concat(F.lit(sign), s))
    tags = F.array(
        told(number(d("word_count")), d("word_count").cast("string"), " words"), told(number(change), F.when(change > 0, "+").otherwise(""), change.cast("string"), " words"),
        told(some(d("h1")), "H1: ", F.substring(d("h1"), 1, H1_SHOWN)),
    )
    tags = F.concat(F.array_compact(tags), many("schemas", ""), many("added_schemas", "+"), many("removed_schemas", "-"))
    return changes.select("id", "change_type", "url", F.concat_ws(" · ", *line).alias("line"), tags.alias("tags"))


def display_type(change_type: Column) -> Column:
    return F.replace(change_type, F.lit("_"), F.lit(" "))


def range_label(days: Column, every: str = "all", custom: str = "range") -> Column:
    """Label of a time filter: a number of days as text, 0 for all time, or custom."""
    return F.when(days == "1", "24h").when(days == "0", every).when(days == "custom", custom).otherwise(F.concat(days, F.lit("d")))
