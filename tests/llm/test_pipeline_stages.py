"""The stages after the first on sf0.01: near copies against brute force over both kinds of links, the rest against their operators."""

import corpus_pipeline
import numpy as np
from test_near_copies import shingles
from test_operators import brute_fp, check_packing

from pagedelta.llm import decontaminate, packing, pii
from pagedelta.llm.common import staged, table

SF = "/root/testdata/sf0.01"


def test_stages_after_the_first(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = staged(stage(spark, docs, SF), "t")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(before)
    fp, sets = {i: brute_fp(before[i]) for i in ids}, {i: shingles(before[i]) for i in ids}
    label, beyond = {i: i for i in ids}, 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            near = (fp[a] ^ fp[b]).bit_count() <= 4
            small, large = sorted((len(sets[a]), len(sets[b])))
            alike = 5 * small >= 4 * large and (shared := len(sets[a] & sets[b])) > 0 and 9 * shared >= 4 * (small + large)
            beyond += alike and not near
            if (near or alike) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if v == hi else v for i, v in label.items()}
    assert beyond
    assert kept["near_duplicates"].keys() == set(label.values())
    rows = spark.createDataFrame(list(kept["near_duplicates"].items()), "doc_id long, text string")
    bad = decontaminate.contamination(rows, table(spark, SF, "benchmark")).filter(decontaminate.is_contaminated())
    assert kept["decontamination"].keys() == kept["near_duplicates"].keys() - {r.doc_id for r in bad.collect()}
    assert kept["personal_data"] == {i: pii.redact(t) for i, t in kept["decontamination"].items()}
    packed = packing.pack(docs, packing.default_tokenizer()).collect()
    encode = packing.encoder(packing.default_tokenizer())
    check_packing(packed, {i: np.append(encode(t or ""), 0).astype("<u4") for i, t in kept["personal_data"].items()}, packing.WINDOW)
