"""Documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Documents without an id cannot be named by a decision and stay. Rows that share an id are one document and stay or
go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagedelta.llm import decontaminate, near_copies, packing, pii, toxicity
from pagedelta.llm.common import checkpointed, crc_bucket, staged, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less those in ``ids``; the ids are at hand before Spark chooses how to join."""
    gone = checkpointed(ids.select(F.col("doc_id").alias("gone")).dropna().distinct())
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    machine = toxicity.fit(docs, labels)
    scored = toxicity.with_score(docs, machine, "_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_copies.near_copies(docs)
    return _without(docs, found.filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter(decontaminate.is_contaminated()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "bigint")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the trained stage nor XXH64 fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
