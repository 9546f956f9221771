"""Robots rules of every host that a run meets, asked for once and kept for a while.

The known hosts are a table of (netloc, body, asked_at). Whoever is about to use urls calls ``meet`` with them: hosts that are not
known, or were asked too long ago, are found by an anti-join and asked for their rules, and the answers join the table. A host
without an answer is known, too, with no rules, which allow everything.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import netloc
from . import documents as D
from .fetch import Client, ask, decoded

KEEP = timedelta(hours=24)


def robots_url(url):
    """Where the rules for a url lie: at its own scheme and host."""
    return F.concat(F.regexp_extract(url, r"^(\w+://[^/?#]*)", 1), F.lit("/robots.txt"))


class Hosts:
    """``known``: HOSTS of earlier runs; ``hold(rows, name)`` writes a table of the run down and reads it back."""

    def __init__(self, known: DataFrame, make_client: Callable[[], Client], delay: float, now: datetime, hold: Callable[[DataFrame, str], DataFrame], keep: timedelta = KEEP):
        self.spark: SparkSession = known.sparkSession
        self.make_client, self.delay, self.now, self.hold = make_client, delay, now, hold
        self.tables = [known.filter(F.col("asked_at") > F.lit(now - keep))]
        self.errors: list[DataFrame] = []

    @property
    def robots(self) -> DataFrame:
        """HOSTS, a row for each host known."""
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def meet(self, urls: DataFrame) -> None:
        """Learn the rules of the hosts of ``urls`` (url) that are not known yet."""
        found = urls.select(netloc(F.col("url")).alias("netloc"), robots_url(F.col("url")).alias("robots")).filter("netloc <> ''")
        # Of a host met by both schemes the secure one is asked.
        new = found.groupBy("netloc").agg(F.max("robots").alias("url")).join(self.robots.select("netloc"), "netloc", "left_anti")
        n = len(self.tables)
        new = self.hold(new, f"hosts-{n}-new")
        if new.isEmpty():
            return
        got = self.hold(ask(new.select("url"), self.make_client), f"hosts-{n}-answers").join(new, "url")
        body = F.when(F.col("error").isNull(), decoded(F.col("content_type"), F.col("body")))
        self.tables.append(self.hold(got.select("netloc", body.alias("body"), F.lit(self.now).cast("timestamp").alias("asked_at")), f"hosts-{n}"))
        self.errors.append(got.filter("error IS NOT NULL").select("netloc", "url", "status_code", "error"))

    def polite(self, urls: DataFrame) -> DataFrame:
        """``urls`` with the seconds that their hosts, all met, ask for between requests."""
        return D.with_delay(urls, self.robots, self.delay)

    def allowed(self, urls: DataFrame) -> DataFrame:
        """Those of ``urls`` that the rules of their hosts, all met, allow."""
        return D.can_fetch(urls, self.robots).filter("allowed").drop("allowed")
