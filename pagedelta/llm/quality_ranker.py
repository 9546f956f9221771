"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

Labelled rows give preference pairs: a document of label 1 is preferred to one of label 0. The strength of a document is
linear in its features; logistic loss on feature differences over all pairs of all labelled rows fits it. A quantile of the
strengths of the labelled rows, the share of label 0 among them, is the threshold; the score is a logistic curve through
``THRESHOLD`` there.

Features are the measurements of the rule ledger as shares, so one definition of each serves rules and ranker, and all
of it stays in built-in functions. They are written down once and read by the fit and by the scores. A pair's loss depends on
two strengths alone, so a step of Newton's method needs, of either label, counts and the first and second moments of the features in
bins of strengths: Spark sums these over every row, and the driver holds at most ``2 * BINS`` rows of them, whatever the table's size.
The losses within a bin, 1 / ``PER_UNIT`` wide, are taken to the second order. The threshold is found exactly, by counts in narrowing ranges.

Defined results: a null text scores as an empty one; null labels are not learned from; where labels hold one class or
none, nothing is preferred and every score is 0.5; repeated rows are scored one by one; only the id and text columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, staged, table
from .quality_rules import ledger

PAIRS = 24
PER_UNIT = 64
BINS = 2048
THRESHOLD = 0.7

FEATURES = {
    "log_words": "ln(1D + n_words)",
    "few_words": "greatest(0D, 12D - n_words)",
    "word_length": "least(40D, word_chars / greatest(1D, n_words))",
    "symbols": "least(4D, n_symbols / greatest(1D, n_words))",
    "exclaims": "least(4D, n_exclaims / greatest(1D, n_words))",
    "letters": "n_letters / greatest(1D, word_chars)",
    "capitals": "n_capitals / greatest(1D, n_letters)",
    "repeats": "n_repeat_words / greatest(1D, n_words)",
    "repeats_any": "ln(1D + n_repeat_words)",
    "duplicate_lines": "n_dup_lines / greatest(1D, n_word_lines)",
    "distinct": "n_distinct_words / pow(greatest(1D, n_words), 0.85D)",
    "failed_rules": "least(1D, bit_count(failed & ~1L))",
    "line_words": "ln(1D + n_words / greatest(1D, n_word_lines))",
}


@dataclass(frozen=True)
class Ranker:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float | None

    def strength(self) -> Column:
        strength = F.lit(0.0)
        for name, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights, strict=True):
            strength = strength + (F.col(name) - F.lit(m)) * F.lit(w / s)
        return strength

    def score(self) -> Column:
        """0 to 1; ``THRESHOLD`` where the strength equals the quantile."""
        if self.cut is None:
            return F.lit(0.5)
        return 1 / (1 + F.exp(-(self.strength() - F.lit(self.cut - math.log(THRESHOLD / (1 - THRESHOLD))))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    led = ledger(docs, id_col, text_col)
    return led.select("doc_id", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 40) -> Ranker:
    """The plain form, over arrays and drawn pairs: Newton's method on the mean logistic loss of ``weights . (preferred - other)``."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(7)
    diff = good[rng.integers(0, len(good), (len(bad), pairs))] - bad[:, None, :]
    diff = diff.reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance that the pair is the wrong way round
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    strength = np.sort(z @ w)
    k = int((y == 0).sum())
    cut = float((strength[k - 1] + strength[k]) / 2)
    return Ranker(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), cut)


def _moments(labelled: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the rows of label 0 and of label 1, by bins of strength: counts, mean strengths, sums of the standardised features and of their products."""
    d = len(mean)
    upper = np.triu_indices(d)
    names = [f"m{k}" for k in range(2 + d + len(upper[0]))]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = (frame[list(FEATURES)].to_numpy(float) - mean) / scale
            s = z @ w
            place = np.clip(np.floor(s * PER_UNIT), -BINS // 2, BINS // 2 - 1).astype(np.int64) + BINS // 2 + BINS * frame["quality"].to_numpy(np.int64)
            bins, at = np.unique(place, return_inverse=True)
            each = [np.ones(len(s)), s, *z.T, *(z[:, i] * z[:, j] for i, j in zip(*upper, strict=True))]
            yield pd.DataFrame({"bin": bins} | {n: np.bincount(at, x, len(bins)) for n, x in zip(names, each, strict=True)})

    rows = labelled.select(*FEATURES, "quality").mapInPandas(sums, "bin long, " + ", ".join(f"{n} double" for n in names))
    got = rows.groupBy("bin").agg(dict.fromkeys(names, "sum")).toArrow().to_pandas().sort_values("bin")
    sides = []
    for label in (0, 1):
        x = got.loc[got["bin"] // BINS == label, [f"sum({n})" for n in names]].to_numpy()
        products = np.zeros((len(x), d, d))
        products[:, upper[0], upper[1]] = products[:, upper[1], upper[0]] = x[:, 2 + d :]
        sides.append([x[:, 0], x[:, 1] / x[:, 0], x[:, 2 : 2 + d], products])
    return sides[0], sides[1]


def newton_step(bad: list[np.ndarray], good: list[np.ndarray], w: np.ndarray, ridge: float) -> np.ndarray:
    """The step on the mean logistic loss of all pairs, of the moments of ``_moments``."""
    (m, t_bad, x_bad, s_bad), (n, t_good, x_good, s_good) = bad, good
    wrong = 1 / (1 + np.exp(np.clip(t_good[:, None] - t_bad, -40, 40)))  # chance that a pair is the wrong way round
    bend = wrong * (1 - wrong)
    pairs = n.sum() * m.sum()
    # Within a bin the chance changes with the strength; its products tell by how much, to the first order.
    of_good = (wrong @ m) @ x_good - (bend @ m) @ (s_good @ w - t_good[:, None] * x_good)
    of_bad = (n @ wrong) @ x_bad + (n @ bend) @ (s_bad @ w - t_bad[:, None] * x_bad)
    grad = (of_bad - of_good) / pairs + ridge * w
    cross = x_good.T @ bend @ x_bad
    curve = (np.tensordot(bend @ m, s_good, 1) + np.tensordot(n @ bend, s_bad, 1) - cross - cross.T) / pairs + ridge * np.eye(len(w))
    return np.linalg.solve(curve, grad)


def around(values: DataFrame, k: int) -> tuple[float, float]:
    """The ``k``-th and the next of the values of column s in ascending order, from 1, by counts in ranges that narrow down."""
    lo, hi = values.agg(F.min("s"), F.max("s")).first()
    above = hi
    while lo < hi:
        part = F.floor((F.col("s") - lo) / (hi - lo) * BINS).alias("part")
        ranges = values.filter(F.col("s").between(lo, hi)).groupBy(part).agg(F.count("s").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("part").collect()
        for i, r in enumerate(ranges):
            if k <= r.n:
                break
            k -= r.n
        if i + 1 < len(ranges):
            above = ranges[i + 1].lo
        lo, hi, size = r.lo, r.hi, r.n
    else:
        size = values.filter(F.col("s") == lo).count()
    return lo, (lo if k < size else above)


def fit_measured(measured: DataFrame, labels: DataFrame, ridge: float = 1e-2, rounds: int = 40) -> Ranker:
    """``measured``: of ``features``; ``labels``: doc_id, quality. Learns from all rows of it."""
    known = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality").cast("int") != 0).cast("int").alias("quality")).dropna()
    labelled = staged(measured.join(known, F.col("doc_id") == F.col("label_id")).select(*FEATURES, "quality"), "quality-labelled")
    spread = [f(n).alias(f"{k}_{n}") for k, f in (("mean", F.avg), ("scale", F.stddev_pop)) for n in FEATURES]
    of = labelled.agg(F.count("quality").alias("n"), F.sum("quality").alias("good"), *spread).first()
    if not of.n or of.good in (0, of.n):
        zeros = (0.0,) * len(FEATURES)
        return Ranker(zeros, (1.0,) * len(FEATURES), zeros, None)
    # Sums come in the order of the tasks; what is rounded here and below does not depend on it.
    mean, scale = (np.array([float(f"{of[f'{k}_{n}']:.12g}") for n in FEATURES]) for k in ("mean", "scale"))
    scale = np.where(scale < 1e-9, 1.0, scale)
    w = np.zeros(len(FEATURES))
    for _ in range(rounds):
        step = newton_step(*_moments(labelled, mean, scale, w), w, ridge)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    ranker = Ranker(tuple(mean.tolist()), tuple(scale.tolist()), tuple(np.round(w, 6).tolist()), 0.0)
    return replace(ranker, cut=sum(around(labelled.select(ranker.strength().alias("s")), of.n - of.good)) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """``labels``: doc_id, quality. Learns from all rows of it."""
    ids = labels.select(F.col("doc_id").alias("label_id"))
    return fit_measured(features(docs.join(ids, F.col("doc_id") == F.col("label_id"), "left_semi")), labels)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score of every document."""
    return features(docs).select("doc_id", ranker.score().alias("score"))


def op1_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 4) != 2)
    measured = staged(features(table(spark, sf_dir, "documents")), "quality-measured")
    ranker = fit_measured(measured, labels)
    return measured.select("doc_id", ranker.score().alias("score")).select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
