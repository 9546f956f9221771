"""From discovered urls to the pages that a run reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def merge_urls(sitemap: DataFrame, feeds: DataFrame) -> DataFrame:
    """Sitemap urls, then feed urls that no sitemap has, in their own order: (domain, url, lastmod, title, source, ordinal)."""
    first = sitemap.select(
        "domain", "url", "lastmod", F.lit("").alias("title"), F.lit("sitemap").alias("source"), F.col("ordinal").cast("bigint").alias("ordinal")
    )
    extra = feeds if "ordinal" in feeds.columns else feeds.withColumn("ordinal", F.lit(0).cast("bigint"))
    extra = extra.join(sitemap.select("domain", "url"), ["domain", "url"], "left_anti")
    extra = extra.groupBy("domain", "url").agg(F.min(F.struct("ordinal", "published", "title")).alias("e"))
    order = F.row_number().over(W.partitionBy("domain").orderBy("e.ordinal", "url"))
    extra = extra.select(
        "domain", "url", F.col("e.published").alias("lastmod"), F.coalesce("e.title", F.lit("")).alias("title"), F.lit("feed").alias("source"),
        (F.lit(1 << 40) + order).alias("ordinal"),
    )
    return first.unionByName(extra)


def prioritize(urls: DataFrame, prev: DataFrame, feeds: DataFrame, max_hash: int = 50, run: int = 0) -> DataFrame:
    """The ``max_hash`` urls of each site to read: new ones, those in feeds, those with a lastmod, then a random rest.

    The random order is a hash of url and run, so a repeated run reads the same pages. Spark keeps ``max_hash`` rows of a site in each
    task before it sorts, so a large site does not gather in one.
    """
    known = prev.select("domain", "url", F.lit(True).alias("known"))
    fed = feeds.select("domain", "url").distinct().withColumn("fed", F.lit(True))
    rows = urls.join(known, ["domain", "url"], "left").join(fed, ["domain", "url"], "left")
    tier = F.when(F.col("known").isNull(), 1).when(F.col("fed"), 2).when(T.truthy(F.col("lastmod")), 3).otherwise(4)
    tie = F.when(tier < 4, F.lpad(F.col("ordinal").cast("string"), 20, "0")).otherwise(F.md5(F.concat_ws(":", F.lit(str(run)), "url")))
    rows = rows.withColumns({"tier": tier, "tie": tie})
    place = F.row_number().over(W.partitionBy("domain").orderBy("tier", "tie", "url"))
    return rows.withColumn("place", place).filter(F.col("place") <= max_hash).select("domain", "url", "tier", "place")
