"""Streams: runs that arrive as they complete, and windowed counts of events.

A page is missing only if a run that read its whole site did not find it, so absence is decided when the run's marker
arrives, not from a micro-batch. ``replay`` does a run in a micro-batch over the versioned store; ``missing_counts`` keeps the
count of missed runs as keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import Store

#: Epoch weeks begin on a Thursday; three days later is Sunday.
WEEK = ("7 days", "7 days", "3 days")


def count_windows(log: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Events by week, from Sunday, and type; on a stream with a watermark, so that weeks close."""
    if log.isStreaming:
        log = log.withWatermark("ts", lateness)
    n = log.groupBy(F.window("ts", *WEEK).alias("w"), "change_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "change_type", "n")


def replay(captures: DataFrame, run_one: Callable[[DataFrame, int, datetime], None], store: Store, checkpoint: str):
    """Process each completed run of a stream (domain, url, html, run, run_ts) in order, once.

    ``run_one`` commits a run to the store. A run that is already committed is passed over, so a micro-batch that is repeated
    after a failure changes nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        for r in rows.select("run", "run_ts").distinct().orderBy("run").collect():  # runs of a micro-batch: a handful
            if r["run"] > store.pointer()["run"]:
                run_one(rows.filter(F.col("run") == r["run"]), r["run"], r["run_ts"])
        rows.unpersist()

    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MissedRuns(StatefulProcessor):
    """Per url: how many completed runs in a row have not found it. Input: (domain, url, run, found); a marker row for each url and
    run says whether the run found it."""

    def __init__(self, threshold: int = 2) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missed = handle.getValueState("missed", "run int, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.missed.get() if self.missed.exists() else (0, 0)
        out, gone = [], False
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.run):
            if r.run <= last:
                continue
            last, n, gone = int(r.run), 0 if r.found else n + 1, False
            if n >= self.threshold:
                out.append((key[0], key[1], last, n))
                n, gone = 0, True
        if gone:
            self.missed.clear()  # a url that was removed needs no state until it is found again
        else:
            self.missed.update((last, n))
        yield pd.DataFrame(out, columns=["domain", "url", "run", "missing_runs"])

    def close(self) -> None:
        pass


def missed_counts(found: DataFrame, threshold: int = 2) -> DataFrame:
    """(domain, url, run, missing_runs): urls removed by a stream of completed runs."""
    return found.groupBy("domain", "url").transformWithStateInPandas(
        statefulProcessor=MissedRuns(threshold), outputStructType="domain string, url string, run int, missing_runs int", outputMode="Append", timeMode="None"
    )
