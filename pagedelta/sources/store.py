"""Versioned snapshots and the changelog, as Parquet.

A run writes a new version and then its pointer, a file of its own that appears by one rename and is never replaced. The
pointer with the largest number counts, so a reader sees the old state or the new one, never half of it, and wherever a run dies
it can be repeated: it writes the same version again. Events are written before the pointer.

The state is kept by domain. A run's manifest says of each domain in which run its pages were written, so a run writes the domains
that it changed and refers to the rest. ``vacuum`` deletes what no manifest of the newest runs, nor of a run that a reader has
leased, refers to.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Pages of a domain in one file of the state, about.
FILE_ROWS = 500_000
_POINTER = re.compile(r"run=(\d+)\.json")


MANIFEST = "domain string, run int"


def _run_of(folder: str) -> int:
    m = re.fullmatch(r"run=(\d+)", folder)
    return int(m[1]) if m else 0


def _unescaped(value: str) -> str | None:
    """A partition's value as it was before Spark made a folder's name of it."""
    return None if value == "__HIVE_DEFAULT_PARTITION__" else re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointers(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/pointer")
        if not fs.exists(at):
            return []
        found = (_POINTER.fullmatch(f.getPath().getName()) for f in fs.listStatus(at))
        return sorted(int(m[1]) for m in found if m)

    def pointer(self) -> dict:
        """{"run": last committed run, "run_ts": its time}; run 0 before the first."""
        runs = self._pointers()
        if not runs:
            return {"run": 0, "run_ts": None}
        return json.loads(self.spark.read.text(f"{self.root}/pointer/run={runs[-1]}.json").collect()[0][0])

    def _turn(self, run: int, run_ts: datetime) -> None:
        fs, new = self._fs(f"{self.root}/pointer/run={run}.json.new")
        _, at = self._fs(f"{self.root}/pointer/run={run}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"run": run, "run_ts": run_ts.isoformat()}).encode()))
        out.close()
        if not fs.rename(new, at) and not fs.exists(at):
            raise OSError(f"run {run} could not be committed")
        for old in self._pointers()[:-2]:
            fs.delete(self._fs(f"{self.root}/pointer/run={old}.json")[1], False)

    def _read(self, path: str, ddl: str) -> DataFrame:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    def work(self, df: DataFrame, name: str) -> DataFrame:
        """Write an intermediate table of the run in progress and read it back."""
        path = f"{self.root}/work/run={self.pointer()['run'] + 1}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_work(self) -> None:
        fs, at = self._fs(f"{self.root}/work")
        fs.delete(at, True)

    def manifest(self, run: int | None = None) -> DataFrame:
        """(domain, run): where the pages of each domain are, as a run, by default the last one, left them; a row for each site."""
        return self._read(f"{self.root}/manifest/run={self.pointer()['run'] if run is None else run}", MANIFEST)

    def _state(self, manifest: DataFrame) -> DataFrame:
        """The pages that a manifest refers to; as a filter on folders, of which there is one a site, it reads no others."""
        by_run: dict[int, list[str | None]] = {}
        for r in manifest.collect():
            by_run.setdefault(r["run"], []).append(r["domain"])
        wanted = F.lit(False)
        for run, domains in sorted(by_run.items()):
            own = F.col("domain").isin([d for d in domains if d is not None])
            wanted = wanted | (F.col("run") == run) & (own | F.col("domain").isNull() if None in domains else own)
        pages = self._read(f"{self.root}/pages", schemas.PAGE_STATE + ", run int")
        return pages.filter(wanted).select(*[c.split()[0] for c in schemas.PAGE_STATE.split(", ")])

    def load_state(self, run: int | None = None) -> DataFrame:
        """Page states of the last committed run, or of one that is leased."""
        return self._state(self.manifest(run))

    def load_sites(self) -> DataFrame:
        return self._read(f"{self.root}/sites/run={self.pointer()['run']}", schemas.SITES)

    def load_changes(self, max_entries: int | None = None) -> DataFrame:
        """Events of the committed runs, with their run; the newest ``max_entries`` of them if that is given."""
        got = self._read(f"{self.root}/changes", schemas.CHANGES + ", run int").filter(F.col("run") <= self.pointer()["run"])
        return got if max_entries is None else retained(got, max_entries)

    def load_errors(self) -> DataFrame:
        """What went wrong in the committed runs, with their run."""
        return self._read(f"{self.root}/errors", schemas.ERRORS + ", run int").filter(F.col("run") <= self.pointer()["run"])

    def load_hosts(self) -> DataFrame:
        """Hosts and their robots rules, as the last committed run knew them."""
        return self._read(f"{self.root}/hosts/run={self.pointer()['run']}", schemas.HOSTS)

    def prune(self, max_entries: int) -> list[int]:
        """Delete runs of the changelog of which none of the newest ``max_entries`` events are; returns their numbers."""
        sizes = self.load_changes().groupBy("run").count().collect()  # a row for each run
        newer, gone = 0, []
        for run, n in sorted(sizes, reverse=True):
            if newer >= max_entries:
                fs, at = self._fs(f"{self.root}/changes/run={run}")
                fs.delete(at, True)
                gone.append(run)
            newer += n
        return gone

    def save(self, changes: DataFrame, state: DataFrame, sites: Callable[[DataFrame], DataFrame], run_ts: datetime, kept: Iterable[str] = (), **tables: DataFrame) -> int:
        """Write a run and turn the pointer. ``sites`` makes the sites table from the whole state as it was written.

        ``state``: pages of the domains that the run changed; ``kept``: domains whose pages stay where they are; ``tables``: errors, hosts.
        """
        at = self.pointer()["run"]
        run, kept = at + 1, list(kept)
        changes.write.mode("overwrite").parquet(f"{self.root}/changes/run={run}")
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        sizes = state.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files"))
        files = F.pmod(F.xxhash64("url"), F.coalesce("_files", F.lit(1)))
        state = state.join(sizes, "domain", "left").repartition("domain", files).drop("_files")
        state.write.mode("overwrite").partitionBy("domain").parquet(f"{self.root}/pages/run={run}")
        written = self._read(f"{self.root}/pages/run={run}", schemas.PAGE_STATE).select("domain", F.lit(run).alias("run")).distinct()
        manifest = written.unionByName(self.manifest(at).filter(F.col("domain").isin(kept))) if kept else written
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/run={run}")
        sites(self._state(self.manifest(run))).write.mode("overwrite").parquet(f"{self.root}/sites/run={run}")
        self._turn(run, run_ts)
        return run

    @contextmanager
    def lease(self, seconds: float = 3600) -> Iterator[int]:
        """The last committed run, which ``vacuum`` leaves alone until the lease ends or runs out."""
        run = self.pointer()["run"]
        fs, at = self._fs(f"{self.root}/leases/run={run}_{int(time.time() + seconds)}_{uuid.uuid4().hex}")
        fs.create(at, True).close()
        try:
            yield run
        finally:
            fs.delete(at, False)

    def _listed(self, path: str) -> list[str]:
        fs, at = self._fs(f"{self.root}/{path}")
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the states that neither the newest ``keep`` runs nor leased ones refer to; returns the folders that went.

        Folders are listed and compared with manifests of a row for each site; no page is read. A vacuum that dies is finished by the
        next. Folders of a run that is not committed yet are left alone.
        """
        last = self.pointer()["run"]
        leases = (re.fullmatch(r"run=(\d+)_(\d+)_\w+", name) for name in self._listed("leases"))
        runs = {run for run in range(max(1, last - keep + 1), last + 1)} | {int(m[1]) for m in leases if m and int(m[2]) > time.time()}
        runs = {run for run in runs if f"run={run}" in self._listed("manifest")}
        used = {(r["domain"], r["run"]) for run in runs for r in self.manifest(run).collect()}
        gone = [f"{name}/{x}" for name in ("manifest", "sites", "hosts") for x in self._listed(name) if _run_of(x) <= last and _run_of(x) not in runs]
        for x in self._listed("pages"):
            if 0 < _run_of(x) <= last:
                held = {d for d, run in used if run == _run_of(x)}
                domains = [d for d in self._listed(f"pages/{x}") if d.startswith("domain=")]
                stale = [d for d in domains if _unescaped(d.removeprefix("domain=")) not in held]
                gone += [f"pages/{x}"] if len(stale) == len(domains) else [f"pages/{x}/{d}" for d in stale]
        for path in gone:
            fs, at = self._fs(f"{self.root}/{path}")
            fs.delete(at, True)
        return gone

    def publish(self, target: str, max_entries: int) -> None:
        """The two JSON artefacts of a run: the sites with their totals, and the retained changelog."""
        self.load_sites().coalesce(1).write.mode("overwrite").json(f"{target}/state")
        self.load_changes(max_entries).coalesce(1).write.mode("overwrite").json(f"{target}/changes")


def retained(log: DataFrame, max_entries: int, newest: tuple[str, ...] = ("run",), tie: tuple[str, ...] = ("domain", "url", "change_type", "id")) -> DataFrame:
    """The newest ``max_entries`` rows of a log. A top-k sort: each task keeps that many rows at most."""
    return log.orderBy(*(F.col(c).desc() for c in newest), *tie).limit(max_entries)


def import_changes(spark: SparkSession, path: str) -> DataFrame:
    """A changelog kept as a JSON array, or as JSON lines as ``Store.publish`` writes them."""
    got = spark.read.schema(schemas.CHANGES + ", run int").option("multiLine", not path.endswith("/changes")).json(path)
    return got.filter(F.col("id").isNotNull())


def total_urls(state: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites with the number of urls in their state, those under the removal threshold included."""
    n = state.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return sites.join(n, "domain", "left").select("domain", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("total_urls_discovered"))
