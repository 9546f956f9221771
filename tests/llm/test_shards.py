"""Shards of archives: ids that crowd, ids heavier than a shard, rows without id."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagedelta.llm import warc

PAGES = "page_id long, url string, html string"


def test_plan_covers_all_ids_in_order(spark):
    rows = [(i, 100) for i in range(200)] + [(10**15 + i, 100) for i in range(50)] + [(7, 5000), (None, 950), (-(2**63), 1), (2**63 - 1, 300)]
    plan = warc.plan_shards(spark.createDataFrame(rows, "id long, bytes long"), 1000)
    digests = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(len(rows))]
    at = plan.of(pd.Series([r[0] for r in rows], dtype="Int64"), pd.Series(digests))
    assert 0 <= at.min() and at.max() < plan.n
    ids = np.array([-(2**63) if r[0] is None else r[0] for r in rows], object)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, ids[k], digests[k]))
    assert [at[k] for k in order] == sorted(at.tolist())
    weight = np.bincount(at, [r[1] for r in rows], plan.n)
    assert plan.n < 60 and weight[at[[k for k, r in enumerate(rows) if r[0] == 100][0]]] <= 1000
    assert plan.cuts.max() >= 5  # the id of 5,100 bytes


@pytest.mark.parametrize("rows", [[], [(None, 5)], [(3, 0)], [(None, 9999), (None, 9999)]])
def test_plan_of_few_rows(spark, rows):
    plan = warc.plan_shards(spark.createDataFrame(rows, "id long, bytes long"), 1000)
    got = plan.of(pd.Series([r[0] for r in rows], dtype="Int64"), pd.Series(["ffffffff"] * len(rows), dtype=object))
    assert plan.n >= 1 and (len(rows) == 0 or got.max() < plan.n)


def test_hot_ids_and_long_records_and_clashing_columns(spark, tmp_path):
    rows = [(5, f"u{i}", f"{i} " * 400, "x", 1, "y") for i in range(60)] + [(None, "n", f"{i} " * 300, "x", 1, "y") for i in range(40)] + [(9, "long", "é" * 300_000, "x", 1, "y")]
    rows += [(5, "same", "same " * 400, None, None, None)] * 3 + [(6, "other", "same " * 400, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES + ", id string, shard int, digest string")
    names = []
    for k in (1, 3):
        root = f"file://{tmp_path}/w{k}"
        manifest = warc.write_archive(pages.repartition(k), root, 4000, 2000)
        assert manifest.agg(F.sum("records"), F.countDistinct("shard")).first()[0] == len(rows)
        names.append(sorted((r["name"], r["sha256"]) for r in manifest.collect()))
        got = warc.read_archive(spark, root).collect()
        assert sorted((r.page_id or 0, bytes(r.payload).decode()) for r in got if r.record_type == "response") == sorted((a or 0, c) for a, _, c, *_ in rows if (a, c) != (5, "same " * 400))
        assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(5, 6)] * 3
    assert names[0] == names[1] and len({n[:12] for n, _ in names[0]}) > 10
