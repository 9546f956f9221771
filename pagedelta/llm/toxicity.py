"""Toxicity: a factorization machine over hashed terms.

A term is a word of letters, lower-cased, or the first ``PREFIX`` letters of a longer one, so that inflected and compound
forms share evidence. A document is the set of its terms' hashes. The machine adds to linear weights one inner product
of factors for each pair of terms that occur together, computed in time linear in the terms; it so learns that an
insult beside a group's name weighs more, or less, than the two apart.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id. Hash slots whose share differs between the
classes beyond chance (chi squared of ``MIN_CHI2`` or more) take part, and so do those of pairs that the machine of the former
leaves unexplained: a score test on its residuals of each pair of the ``PAIR_SLOTS`` slots that divide the rows most evenly, at
``MIN_PAIR`` for the millions of pairs. A pair that counts only together is so learnt though neither word counts alone. The rest
weigh nothing, so that the length of a text does not move its score. Terms are hashed in the JVM over whole texts; only hash lists go to Python, in Arrow batches.

Defined results: a null or wordless text scores as an empty one; null labels are not learned from; where labels hold one
class or none, every score is 0; repeated rows are scored one by one; an empty table gives an empty result; extra
columns pass through ``with_score`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, table

SAMPLE = 10_000
SLOTS = 1 << 18
PREFIX = 4
FACTORS = 4
MIN_CHI2 = 30.0
PAIR_SLOTS = 1024
MIN_PAIR = 60.0
THRESHOLD = 0.5


def terms(text: Column) -> Column:
    """Distinct hash slots of a text's terms."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"))
    words = F.array_remove(words, "")
    heads = F.array_distinct(F.transform(words, lambda w: F.concat(F.substring(w, 1, PREFIX), F.lit("*"))))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")
    return F.array_distinct(F.concat(F.transform(words, slot), F.transform(heads, slot)))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the row of each."""
    sizes = lists.map(len).to_numpy(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32, copy=False)
    return flat, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


@dataclass
class Machine:
    bias: float
    slots: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        at = np.full(SLOTS, -1, np.int32)
        at[self.slots] = np.arange(len(self.slots))
        term = at[flat]
        term, row = term[term >= 0], row[term >= 0]
        out = self.bias + np.bincount(row, self.linear[term], n)
        for v in self.factors.T:
            out += 0.5 * (np.bincount(row, v[term], n) ** 2 - np.bincount(row, v[term] ** 2, n))
        return out

    def score(self, lists: pd.Series) -> np.ndarray:
        flat, row = _flat(lists)
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, row, len(lists)), -30, 30)))


def unexplained(flat: np.ndarray, row: np.ndarray, residual: np.ndarray, weight: np.ndarray, slots: np.ndarray, rows: int = 250) -> np.ndarray:
    """Slots of the pairs, out of ``slots``, whose score test on the residuals exceeds ``MIN_PAIR``. ``flat`` is in the order of ``row``."""
    m, n = len(slots), len(residual)
    at = np.full(SLOTS, -1, np.int32)
    at[slots] = np.arange(m)
    gain, spread, part = (np.zeros((m, m), np.float32) for _ in range(3))
    for k in range(0, n, rows):
        lo, hi = np.searchsorted(row, (k, k + rows))
        term, own = at[flat[lo:hi]], row[lo:hi] - k
        x = np.zeros((min(rows, n - k), m), np.float32)
        x[own[term >= 0], term[term >= 0]] = 1
        for total, by in ((gain, residual), (spread, weight)):
            total += np.matmul(x.T, x * by[k : k + rows, None].astype(np.float32), out=part)
    np.fill_diagonal(gain, 0)
    gain *= gain
    np.maximum(spread, 1, out=spread)  # a pair of almost no weight tells nothing
    spread *= MIN_PAIR
    return slots[(gain > spread).any(0)]


def fit_machine(lists: pd.Series, y: np.ndarray, rounds: int = 600, rate: float = 0.05, ridge: float = 4e-5) -> Machine:
    n = len(y)
    flat, row = _flat(lists)
    n1 = y.sum()
    if not 0 < n1 < n:
        return Machine(-30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    all_, with_ = np.bincount(flat, minlength=SLOTS), np.bincount(flat, y[row], SLOTS)
    gap = with_ / n1 - (all_ - with_) / (n - n1)
    share = np.clip(all_ / n, 1e-12, 1 - 1e-12)
    chi2 = gap**2 / (share * (1 - share) * (1 / n1 + 1 / (n - n1)))
    slots = np.flatnonzero((chi2 >= MIN_CHI2) & (all_ >= 4))
    machine = trained(slots, flat, row, y, rounds, rate, ridge)
    p = 1 / (1 + np.exp(-np.clip(machine.raw(flat, row, n), -30, 30)))
    even = all_ * (n - all_)
    common = np.sort(np.argsort(-even, kind="stable")[:PAIR_SLOTS])
    more = np.union1d(slots, unexplained(flat, row, y - p, p * (1 - p), common[even[common] > 0]))
    return machine if len(more) == len(slots) else trained(more, flat, row, y, rounds, rate, ridge)


def trained(slots: np.ndarray, flat: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int, rate: float, ridge: float) -> Machine:
    """The machine over ``slots``: full-batch Adam on the logistic loss."""
    n = len(y)
    at = np.full(SLOTS, -1, np.int32)
    at[slots] = np.arange(len(slots))
    term = at[flat]
    term, row = term[term >= 0], row[term >= 0]
    m = len(slots)
    rng = np.random.default_rng(11)
    p = {"b": np.zeros(1), "w": np.zeros(m), "v": rng.normal(0, 0.01, (m, FACTORS))}
    mean, var = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, rounds + 1):
        v = p["v"]
        sums = [np.bincount(row, v[term, f], n) for f in range(FACTORS)]
        squares = sum(np.bincount(row, v[term, f] ** 2, n) for f in range(FACTORS))
        raw = p["b"][0] + np.bincount(row, p["w"][term], n) + 0.5 * (sum(s**2 for s in sums) - squares)
        g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / n
        grad = {
            "b": g.sum(keepdims=True),
            "w": np.bincount(term, g[row], m) + ridge * p["w"],
            "v": np.stack([np.bincount(term, g[row] * (sums[f][row] - v[term, f]), m) for f in range(FACTORS)], 1) + ridge * v,
        }
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
            var[k] = 0.999 * var[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-9)
    return Machine(float(p["b"][0]), slots, p["w"], p["v"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """``labels``: doc_id, toxic. Learns from ``sample`` rows of it at most."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    got = rows.select("doc_id", terms(F.col("text")).alias("terms"), "toxic").toArrow()  # collected as rows, every hash would be an object in the driver
    got = got.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])  # here, for a sort in Spark would evaluate the terms twice
    return fit_machine(got["terms"].to_pandas(), (got["toxic"].to_numpy() != 0).astype(float))


def with_score(docs: DataFrame, machine: Machine, to: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the score."""

    @F.pandas_udf("double")
    def scored(lists: pd.Series) -> pd.Series:
        return pd.Series(machine.score(lists))

    return docs.withColumn(to, scored(terms(F.col(text_col))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fit(docs, labels.filter(crc_bucket(F.col("doc_id"), 5) != 0))
    return with_score(docs.select("doc_id", "text"), machine).select(
        "doc_id",
        (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
