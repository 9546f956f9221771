"""The trained operators against plain forms of what they compute, and queries over tables with odd columns."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagedelta.llm import pii, quality_ranker, registry, simhash, toxicity


def test_machine_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    slots = np.sort(rng.choice(toxicity.SLOTS, 30, replace=False))
    machine = toxicity.Machine(-0.3, slots, rng.normal(0, 1, 30), rng.normal(0, 1, (30, toxicity.FACTORS)))
    lists = [rng.choice(slots, rng.integers(0, 12), replace=False) for _ in range(50)] + [np.array([1, 2, 3]), np.zeros(0, np.int64)]
    at = {s: k for k, s in enumerate(slots)}
    want = []
    for terms in lists:
        own = [at[t] for t in terms if t in at]
        raw = machine.bias + sum(machine.linear[k] for k in own) + sum(machine.factors[i] @ machine.factors[j] for i, j in itertools.combinations(own, 2))
        want.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(machine.score(pd.Series(lists)), want)


@pytest.mark.parametrize("kind", ["one of two", "both", "first alone"])
def test_machine_learns_pairs_that_count_only_together(kind):
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + list(rng.integers(10, 4000, 5)), np.int64))
        y.append(float({"one of two": a != b, "both": a and b, "first alone": a and not b}[kind]))
    machine = toxicity.fit_machine(pd.Series(rows[:2000]), np.array(y[:2000]))
    held = machine.score(pd.Series(rows[2000:])) >= 0.5
    assert (held == (np.array(y[2000:]) == 1)).mean() >= 0.95


def test_a_pair_of_weak_words_is_learnt():
    """Neither word tells anything alone: both are as common in clean rows; 10,000 rows, a tenth toxic."""
    rng = np.random.default_rng(6)
    rows, y = [], []
    for _ in range(10_000):
        toxic = rng.random() < 0.1
        a, b = (True, True) if toxic and rng.random() < 0.5 else (rng.random() < 0.08, False) if rng.random() < 0.5 else (False, rng.random() < 0.08)
        rows.append(np.array([1] * a + [2] * b + list(rng.integers(10, 4000, 20)), np.int64))
        y.append(float(toxic))
    machine = toxicity.fit_machine(pd.Series(rows), np.array(y))
    both, one, two, none = machine.score(pd.Series([np.array([1, 2]), np.array([1]), np.array([2]), np.zeros(0, np.int64)]))
    assert both > 0.9 and max(one, two, none) < 0.5


def test_terms_reach_the_driver_as_arrow(spark, monkeypatch):
    """As rows, each hash of a labelled text would be an object in the driver's memory."""
    docs = spark.createDataFrame([(i, "you utter scum" if i % 3 == 0 else f"a fine day number {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS INT) AS toxic")

    def rows(_):
        raise AssertionError("collected as rows")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, rows)
    machine = toxicity.fit(docs, labels)
    assert machine.slots.size and machine.bias > -30


def test_ranker_is_where_the_loss_of_its_pairs_is_least():
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.6).astype(int)
    x = np.c_[y + rng.normal(0, 1, 300), rng.normal(0, 3, 300), np.ones(300)]
    ranker = quality_ranker.fit_pairs(x, y, pairs=8)
    z = (x - np.array(ranker.mean)) / np.array(ranker.scale)
    good, bad = z[y == 1], z[y == 0]
    draw = np.random.default_rng(7).integers(0, len(good), (len(bad), 8))
    diff = (good[draw] - bad[:, None, :]).reshape(-1, 3)

    def loss(w):
        return np.log1p(np.exp(-diff @ w)).mean() + 0.5e-2 * w @ w

    best = np.array(ranker.weights)
    assert all(loss(best) <= loss(best + step) for step in rng.normal(0, 1e-2, (200, 3)))
    strength = z @ best
    assert (strength > ranker.cut).sum() == y.sum()


def test_ranker_learns_from_all_pairs_of_all_rows(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(["word", "and", "more#", "TEXT!", f"n{i}"][k] for k in rng.integers(0, 5, rng.integers(3, 60)))) for i in range(120)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 7 > 2 AS INT) AS quality")
    ranker = quality_ranker.fit(docs, labels)
    x = quality_ranker.features(docs).toPandas().sort_values("doc_id")[list(quality_ranker.FEATURES)].to_numpy(float)
    y, z, w = np.arange(120) % 7 > 2, (x - np.array(ranker.mean)) / np.array(ranker.scale), np.array(ranker.weights)
    diff = (z[y][:, None] - z[~y][None]).reshape(-1, x.shape[1])
    slope = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(0) + 1e-2 * w
    assert np.allclose(ranker.mean, x.mean(0)) and np.abs(slope).max() < 1e-4
    assert (z @ w > ranker.cut).sum() == y.sum()


def test_neighbours_of_a_rank():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    values = [1.0, 1.0, 2.0, 2.0 + 1e-12, 5.0, 5.0, 1e9]
    rows = spark.createDataFrame([(v,) for v in values], "s double")
    assert [quality_ranker.around(rows, k) for k in range(1, 7)] == list(itertools.pairwise(values))
    assert quality_ranker.around(rows.filter("s = 5"), 1) == (5.0, 5.0)


def test_scores_equal_a_plain_form_and_ties_count_as_good(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    measured = quality_ranker.features(docs).toPandas().sort_values("doc_id")
    x = measured[list(quality_ranker.FEATURES)].to_numpy(float)
    rng = np.random.default_rng(1)
    n = x.shape[1]
    ranker = quality_ranker.Ranker(tuple(x.mean(0)), (2.0,) * n, tuple(rng.normal(0, 0.01, n)), 0.0)
    strength = ((x - x.mean(0)) / 2) @ np.array(ranker.weights)
    at = quality_ranker.THRESHOLD
    want = 1 / (1 + np.exp(-(strength + np.log(at / (1 - at)))))
    got = quality_ranker.score(docs, ranker).toPandas().sort_values("doc_id")["score"]
    assert np.allclose(got, want)
    tie = quality_ranker.Ranker((0.0,) * n, (1.0,) * n, (0.0,) * n, 0.0)
    scores = [r.score for r in quality_ranker.score(docs, tie).collect()]
    assert np.allclose(scores, at)


def test_trees_follow_few_edges():
    """Exact, and of a tree's nodes a query meets fewer than all."""
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64) & np.uint64((1 << 40) - 1))
    forest = simhash.Forest(np.zeros(len(fp), np.int64), fp)
    ask = fp[:200] ^ np.uint64(0b1011)
    found = {(int(q), int(n)) for a, b in forest.near(np.zeros(200, np.int64), ask, 4) for q, n in zip(a, b, strict=True)}
    assert found == {(q, int(n)) for q in range(200) for n in np.flatnonzero(np.bitwise_count(ask[q] ^ fp) <= 4)}
    assert forest.visited < 0.9 * 200 * len(fp)


@pytest.mark.parametrize("n", [0, 5, 10**6, 10**9, 10**13])
def test_runs_hold_every_pair_within_the_radius(n):
    width, equal = simhash.runs(n, 4)
    assert sum(width) == 64 and len(width) - equal == 4 and min(width) >= 9


def test_queries_over_tables_with_clashing_columns(spark, tmp_path):
    extra = [F.lit(k).alias(k) for k in ("fp", "words", "key", "found", "plain", "terms", "label_id", "hits", "gone", "batch", "part", "n", "id", "host", "score", "component_id", "html_", "nth")]
    rows = spark.createDataFrame([(i, f"document number {i} mail a{i}@b.co or b{i} at c dot com and more words here", None, None, i) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.select("*", *extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)], "doc_id long, quality int, toxic int").select("*", F.lit("x").alias("text"), F.lit("y").alias("terms")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "mail a3@b.co or b3")], "item_id long, text string").select("*", *extra).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"https://a.org/{i}", f"<article><p>Page {i}</article>") for i in range(5)], "page_id long, url string, html string").select("*", *extra).write.parquet(str(tmp_path / "pages.parquet"))
    for name, run in registry.QUERIES.items():
        got = run(spark, str(tmp_path))
        key = "page_id" if "page_id" in got.columns else "doc_id"
        assert got.select(key).distinct().count() == (5 if key == "page_id" else 12), name


def test_spelled_digits_of_any_number_and_language():
    def phones(text):
        return [text[a:b] for k, a, b, _ in pii.find(text) if k == "phone"]

    assert phones("call four four four four four four four four four four") == ["four four four four four four four four four four"]
    assert phones("ring +49 170 one two three 4567 now") == ["+49 170 one two three 4567"]
    assert phones("Ruf null eins sieben zwei drei vier fünf sechs sieben acht an") == ["null eins sieben zwei drei vier fünf sechs sieben acht"]
    assert phones("le zéro six un deux trois quatre cinq six sept huit") == ["zéro six un deux trois quatre cinq six sept huit"]
    assert phones("el cero uno dos tres cuatro cinco seis siete ocho nueve") == ["cero uno dos tres cuatro cinco seis siete ocho nueve"]
    assert phones("in 2020 2021 2022 one two") == [] and phones("un peu de tout, dos o tres") == []
