"""Stages of the pipeline against what their operators decide, on real and on odd rows."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_near_copies import shingles
from test_operators import ODD_ROWS, brute_fp, check_packing

from pagedelta.llm import decontaminate, packing, pii
from pagedelta.llm.common import staged, table


SF = "/root/testdata/sf0.01"  # the smallest with labels enough to learn from


def test_stages(spark):
    sf_dir = SF
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "t")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").filter("toxic = 1").collect()}
    n = table(spark, sf_dir, "documents").count()
    assert 0.8 * n < len(kept["toxicity"]) <= n and len(toxic & kept["toxicity"].keys()) < len(toxic)
    # One document of each group of near copies stays, the one with the smallest id; copies are linked by fingerprints or by shingles.
    fp = {i: brute_fp(t) for i, t in kept["toxicity"].items()}
    near = kept["near_duplicates"]
    assert not any((fp[a] ^ fp[b]).bit_count() <= 4 for a in near for b in near if a < b)
    sets = {i: shingles(t) for i, t in kept["toxicity"].items()}
    for i in fp.keys() - near.keys():
        assert any((fp[i] ^ fp[j]).bit_count() <= 4 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0 for j in fp if j != i)
    rows = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    bad = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark")).filter(decontaminate.is_contaminated())
    assert kept["decontamination"].keys() == near.keys() - {r.doc_id for r in bad.collect()}
    assert kept["personal_data"] == {i: pii.redact(t) for i, t in kept["decontamination"].items()}
    packed = packing.pack(docs, packing.default_tokenizer()).collect()
    encode = packing.encoder(packing.default_tokenizer())
    check_packing(packed, {i: np.append(encode(t or ""), 0).astype("<u4") for i, t in kept["personal_data"].items()}, packing.WINDOW)


def test_stages_on_odd_and_no_rows(spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    odd = spark.createDataFrame([(r[0], r[1], r[2], None, r[6]) for r in ODD_ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        docs = rows.select(*columns)
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, sf_dir), "t")
        assert docs.filter(F.col("doc_id").isNull()).count() == (rows.count() > 0)


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
