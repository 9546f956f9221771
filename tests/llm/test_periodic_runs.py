"""Periodic runs against their definition, on planted, random, pathological and real texts."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import ODD, ODD_ROWS

from pagedelta.llm import periodic_runs as pr
from pagedelta.llm.common import table


def brute(w):
    """Every (start, length, period) by its definition: per period the maximal stretches, less those with a smaller period."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q):
                out.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def found(*texts):
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    return pr.find(codes, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))


@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_two_letters(texts):
    assert found(*texts) == [brute(t) for t in texts]


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_powers(parts):
    text = "".join(u * k for u, k in parts)
    assert found(text) == [brute(text)]


def test_nested_and_neighbouring_runs():
    rng = random.Random(1)
    for _ in range(150):
        u = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        v = u * rng.randint(1, 7) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + v * rng.randint(1, 6) + u * rng.randint(0, 6)
        assert found(text, text[3:]) == [brute(text), brute(text[3:])]


@pytest.mark.parametrize("m", [5, 17, 40])
def test_blocks_that_are_periodic_themselves(m):
    for text in (("a" * m + "b") * 6, ("ab" * m + "c") * 5 + "ab" * m, ("a" * m + "b") * 3 + "a" * (m + 2) + "b" + ("a" * m + "b") * 4):
        assert found(text) == [brute(text)]


def test_small_pieces_give_the_same(monkeypatch):
    monkeypatch.setattr(pr, "PIECE", 16)
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice("ab") * rng.randint(1, 8) for _ in range(30)) + "abcab" * rng.randint(2, 30)
        assert found(text) == [brute(text)]


def test_time_on_long_and_odd_texts():
    began = time.process_time()
    fib = ["a", "ab"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    texts = ("a" * 200_000, ("a" * 999 + "b") * 100, ("a" * 20_000 + "b") * 9, "ab" * 50_000 + "c" + "ab" * 50_000, fib[-1])
    got = found(*texts)
    assert got[0] == [(0, 200_000, 1)] and (0, 100_000, 1000) in got[1] and (0, 180_009, 20_001) in got[2]
    assert time.process_time() - began < 30


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, n)]


def expected(i, text):
    w = planted(i, words(text))
    codes = {}
    runs = pr.find(np.array([codes.setdefault(x, len(codes)) for x in w], np.int64), np.array([0, len(w)])) if len(w) > 1500 else [brute(w)]
    runs = runs[0]
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_query_equals_brute_force(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in pr.op12_periodic_runs(spark, sf_dir).collect()}
    assert got == {expected(r.doc_id, r.text) for r in rows} and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD)
    got = pr.periodic_runs(odd).collect()
    assert len(got) == len(ODD_ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].runs == [] and by[1].collapsed == "" and by[3].n_words == 0
    assert [tuple(r) for r in by[6].runs] == [(0, 30_000, 1)] and by[6].collapsed == "w"
    assert by[None].collapsed == "no id here" and pr.periodic_runs(odd.limit(0)).count() == 0
