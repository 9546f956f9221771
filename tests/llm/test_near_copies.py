"""The pipeline's near-duplicate stage against planted copies and brute force."""

import random

import corpus_pipeline
from test_operators import brute_fp

DOCS = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_planted_copies_down_to_the_similarity(spark, sf_dir):
    rng = random.Random(3)
    texts, common = [], "this line stands in every text of the table without any change"
    for size in (12, 60, 240, 240, 600, 600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts.append(" ".join(base) + " " + common)
        for edits in (1, 2, 4, 6, 8, 10, 14):
            copy = list(base)
            for at in rng.sample(range(size), min(edits, size)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy) + " " + common)
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "one two"), (103, "One  two"), (None, texts[0]), (104, texts[8])]
    rng.shuffle(rows)
    known = [(i, t) for i, t in rows if i is not None]
    sets, fps = {i: shingles(t) for i, t in known}, {i: brute_fp(t) for i, t in known}
    label, beyond = {i: i for i in sets}, 0
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            alike = shared > 0 and 9 * shared >= 4 * (len(sets[a]) + len(sets[b]))
            near = (fps[a] ^ fps[b]).bit_count() <= 4
            beyond += alike and not near
            if (alike or near) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert beyond
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), sf_dir).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(label.values()))
    assert [r.text for r in got if r.doc_id is None] == [texts[0]]


def test_signatures_rule_out_no_similar_pair(spark):
    """Clusters of which few members are linked to the least or the greatest; found by signatures, with shards of a few sets."""
    import numpy as np

    from pagedelta.llm import near_copies

    rng = random.Random(8)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(30):
            copy = list(base)
            for at in rng.sample(range(150), rng.randrange(2, 7)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) or (brute_fp(texts[a]) ^ brute_fp(texts[b])).bit_count() <= 4:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if v == hi else v for v in label]
    assert 3 < len(set(label)) < len(texts)
    held, near_copies.SHARD = near_copies.SHARD, 8
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    near_copies.SHARD = held
    assert got == dict(enumerate(label))
    lists = spark.createDataFrame([([5, 5, 512 + 5, 7],), ([],)], "s array<long>")
    bits = [np.array(r[0]) for r in lists.select(near_copies.signatures("s")).collect()]
    assert [sum((int(x) % 2**64).bit_count() for x in b) for b in bits] == [1, 0]
