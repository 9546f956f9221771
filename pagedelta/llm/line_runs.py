"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by hash, that says of each key in how many documents it was found and
which has the largest id. Documents come in batches. A batch counts its own keys, merge-anti-joins the runs to find the
keys that none of them holds, and adds those as a run of level 0; what the runs hold already goes to a ledger of repeats.
A key is thus in one run only. Once a level has ``FANOUT`` runs they are merged into one run of the next level, so a batch
meets a number of runs that grows with the logarithm of the batches. Runs share their bucketing, so that joins with them
shuffle nothing but the new batch.

Decisions come from the runs and the repeats together: a key of at least ``MIN_CHARS`` code points in at least ``MIN_DOCS``
documents loses its lines in every document but the one with the largest id. Keys are compared by 128 bits of hash.

Defined results: a null or empty text is one empty line; rows that share an id are one document, whether their texts are
equal or not; rows without an id together are one document, with less than every id; only the id and text columns are read,
so other names cannot clash; a table without rows, or without long lines, drops nothing. Texts are read whole. Time is linear
in a text's lines.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, scratch_path, staged, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, a hash of the row's text, position and key of every line long enough to be judged."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.posexplode(lines_of(F.col(text_col))))
    rows = rows.withColumn("key", line_key(F.col("col"))).filter(F.length("key") >= min_chars)
    return rows.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


#: Scans of one file a bucket count as sorted, so that merge joins with runs need no sort. A union of bucketed scans, whose
#: partitions are not those of its key, must not pass for bucketed.
_PLANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def _planned(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _PLANS}
    for k, v in _PLANS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """The runs and repeats of the batches added so far: ``h1, h2, n_docs, last_doc`` each."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def _written(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", "zstd")
        writer.option("path", scratch_path(self.spark, name)).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # the relation is resolved before its name goes; the files stay
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def _merged(self, tables: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, tables)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keyed: DataFrame) -> DataFrame:
        """Add a batch of documents that no earlier batch had; returns the batch's run, the keys met for the first time."""
        with _planned(self.spark):
            docs = keyed.select(*KEY, "doc_id").distinct()
            counted = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
            earlier = self.runs()
            run = self._written(counted)
            if earlier:
                batch = run
                run = self._written(reduce(lambda x, old: x.join(old.hint("merge"), KEY, "left_anti"), earlier, batch))
                self.repeats.append(self._written(batch.join(run.hint("merge"), KEY, "left_anti")))
            self._put(run, 0)
            return run

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._written(self._merged(full)), level + 1)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys of at least so many documents, with the largest id of those."""
        with _planned(self.spark):
            return staged(self._merged([*self.runs(), *self.repeats]).filter(F.col("n_docs") >= min_docs), "line-frequent")


def _batched(keyed: DataFrame, batches: int) -> DataFrame:
    """The lines with a batch number: ranges of ids with about as many lines each, the largest ids first, no id last."""
    at = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = keyed.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, at)), 1000)).head()[0] if at else []
    number = reduce(lambda x, cut: x + F.when(F.col("doc_id") > cut, 0).otherwise(1), sorted(set(cuts or [])), F.lit(0))
    return keyed.withColumn("batch", number.cast("int"))


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """doc_id, text without its dropped lines, n_lines before, n_dropped."""
    spark = docs.sparkSession
    keyed = staged(keyed_lines(docs, id_col, text_col, min_chars), "line-keys")
    keyed = _batched(keyed, batches)
    store = LineRuns(spark)
    for b in range(batches):
        store.add(keyed.filter(F.col("batch") == b))
    hits = keyed.join(store.frequent(min_docs), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    drops = hits.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("of")).agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of")), "left")
    lines = lines_of(F.col("text"))
    rows = rows.withColumn("lines", lines).withColumn("n", F.size("lines"))

    def between(i: Column) -> Column:
        """The lines from after one dropped line to before the next."""
        start = F.when(i == 0, 0).otherwise(F.col("drops")[F.greatest(i - 1, F.lit(0))] + 1)
        end = F.when(i == F.size("drops"), F.col("n")).otherwise(F.try_element_at("drops", (i + 1).cast("int")))
        return F.slice("lines", start + 1, end - start)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("drops")), between)), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("text"),
        F.col("n").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANKS = " || ".join(f"chr({ord(c)})" for c in SPACES)
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM x),
f AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last_doc AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r
"""
