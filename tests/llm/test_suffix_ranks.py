"""The plain form of prefix doubling against brute force, and the registered form against the plain one."""

import random

import numpy as np

from pagedelta.llm import suffix_dedup, suffix_ranks

DOCS = "doc_id long, text string"


def corpus():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "é", "über", "x", "delta"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    rows = [(i, " ".join(rng.choice(passages)[rng.randrange(60) :] if rng.random() < 0.5 else str(rng.random()) for _ in range(rng.randrange(5)))) for i in range(40)]
    return [*rows, (50, "ab" * 100), (51, "ab" * 60), (52, None), (53, ""), (54, "q" * 49), (55, "q" * 49), (None, rows[3][1]), rows[4], rows[4]]


def test_plain_form_equals_brute_force_and_the_registered_form(spark):
    rows = corpus()
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49) if i is not None else ():
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = {(i, p) for i, t in rows if i is not None for b in [(t or "").encode()] for p in range(len(b) - 49) if first[b[p : p + 50]] < i}
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {(r.doc, r.pos) for r in suffix_ranks.removed_starts(docs).collect()} == want
    covered = {(i, q) for i, p in want for q in range(p, p + 50)}
    got = {(r.doc_id, q) for r in suffix_dedup.repeated(docs).collect() for s in r.spans for q in range(s.start, s.end)}
    assert got == covered


def test_names_that_agree_are_told_apart_by_their_checks():
    name, check, ids = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([5, 6, 8, 6])
    merged = suffix_dedup.Merged(name, check, ids, 4)
    assert merged.least.tolist() == [5, 6, 6] and merged.many.tolist() == [True, False, False]
    assert merged.find(name, check).tolist() == [0, 1, 0, 2]
    got = suffix_dedup._sorted_bucket(merged.rows(0).assign(bucket=0).iloc[:1]) if len(merged.parts) == 1 else None
    assert got is None or len(got) == 1
    a = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 49 + b"z", np.uint8)
    x = suffix_dedup.checks(a, np.array([0, 50, 100]))
    assert len(set(x.tolist())) == 3
