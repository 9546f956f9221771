"""Prefix doubling in its plain form: every position is a row.

A position's first rank is its first ``HEAD`` bytes as a number. A round puts each position's rank beside that of the position as
many bytes on as the rank covers, sorts the distinct pairs with Spark, and numbers them in that order: the rank of twice as many
bytes. A position whose pair no other document has is dropped, and with it whatever would need it. The last round covers
``LENGTH`` bytes, its halves overlapping where they must; the starts of removed strings are the positions whose rank a smaller
document has too.

Ranks are exact: bytes are compared, not hashes. All positions are shuffled in each round, so a corpus costs some forty times its
size; ``suffix_dedup`` gives the same result for a fraction and is what is registered.

Defined results: as in ``suffix_dedup``; a rank that all documents share is numbered once and met by a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

HEAD = 7
LENGTH = 50


def _numbered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with their place in sorted order, ``rank``: the place within a partition, after all partitions before it."""
    rows = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    rows = staged(rows.select("a", "b", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "ranks-sorted")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).collect()  # a row for each partition
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], before - r["least"]))
        before += r["size"]
    offsets = rows.sparkSession.createDataFrame(starts, "part int, offset long")
    return rows.join(F.broadcast(offsets), "part").select("a", "b", (F.col("n") + F.col("offset")).alias("rank"))


def removed_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos): the byte positions of the strings of ``LENGTH`` bytes that a smaller document also has. Rows of one id are one document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("b")).dropna()
    rows = rows.withColumn("text", F.monotonically_increasing_id()).filter(F.octet_length("b") >= LENGTH)
    each = rows.select("doc", "text", F.explode(F.sequence(F.lit(0), F.octet_length("b") - HEAD)).alias("pos"), "b")
    rank = F.conv(F.hex(F.substring("b", F.col("pos") + 1, F.lit(HEAD))), 16, 10).cast("long")
    ranks = staged(each.select("doc", "text", F.col("pos").cast("int").alias("pos"), rank.alias("rank")), "ranks")
    size = HEAD
    while size < LENGTH:
        step = min(size, LENGTH - size)
        on = ranks.select("text", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = staged(ranks.select("doc", "text", "pos", F.col("rank").alias("a")).join(on, ["text", "pos"]), "ranks-pairs")
        kept = pairs.groupBy("a", "b").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
        numbered = _numbered(kept.select("a", "b")).join(kept, ["a", "b"])
        size += step
        ranks = staged(pairs.join(numbered, ["a", "b"]).select("doc", "text", "pos", "rank", "lo"), "ranks")
    return ranks.filter("doc > lo").select("doc", "text", "pos").select("doc", "pos").distinct()
