"""The audit of sources against its SQL and, on odd rows, against exact arithmetic over whole dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same, views
from test_operators import ODD, ODD_ROWS

from pagedelta.llm import source_tries as tries


def brute(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for at, s in groups if at == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


def check(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = sorted(tuple(r) for r in tries.audit(docs, **settings).collect())
    assert got == brute(rows, **settings)
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    same(tries.op11_source_divergence(spark, sf_dir).toPandas(), views(sf_dir).execute(tries.OP11_SQL).df())


@given(st.lists(st.tuples(st.binary(max_size=6) | st.text("ab", max_size=9).map(str.encode), st.integers(0, 3), st.integers(1, 9)), max_size=60))
@settings(max_examples=300, deadline=None)
def test_trie_holds_what_was_added_in_byte_order(added):
    held, tries.BURST = tries.BURST, 2
    trie, want = tries.Trie(), defaultdict(lambda: [0])
    for term, key, n in added:
        leaf = trie.leaf(term)
        leaf[0] += 1
        leaf += [key, n]
        want[term][0] += 1
        want[term] += [key, n]
    tries.BURST = held
    assert list(trie.items()) == sorted(want.items())


def rows_of(seed, n=120, sources=4):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "café", "École", "x世界", "\U0001f600a", "a", "ab", "abc", "don't", "e9mail", "zz_top", "", "\U00010000"]
    return [(("en", "de")[i % 2], f"s{rng.integers(sources)}", " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(n)]


def test_parts_of_two_languages(spark):
    got = check(spark, rows_of(0))
    assert {r[2] for r in got} == {"pair", "term"}
    check(spark, rows_of(1), min_docs=20, top=2)


def test_nulls_sources_without_terms_and_ties(spark):
    rows = [(None, None, "one two"), ("", "s", "one two"), ("", None, "one"), ("en", "a", None), ("en", "b", ""), ("en", "c", "1 2 3")]
    check(spark, rows)
    check(spark, [*rows, *[("en", s, " ".join(f"t{c}" for c in "dcba")) for s in "xxxyyyzz"], ("fr", "alone", "mot mot"), ("fr", "alone", "mot"), ("fr", "alone", "mot")], top=3)
    check(spark, rows * 3)


def test_counts_that_are_written_down_often(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK_BYTES", 99)
    monkeypatch.setattr(tries, "RANGE_ROWS", 7)
    monkeypatch.setattr(tries, "BURST", 3)
    monkeypatch.setattr(tries, "CELLS", 8)
    check(spark, rows_of(2))


def test_shares_stay_exact_beyond_64_bits():
    total = 8 * 10**15
    counts = np.array([0, 1, 10**13, total - 2], np.int64)
    assert tries.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD).selectExpr("lang", "words AS source", "text", "doc_id AS rank", "n_chars AS value")
    assert sorted(tuple(r) for r in tries.audit(odd).collect()) == brute([(r.lang, r.source, r.text) for r in odd.collect()])
    assert tries.audit(odd.limit(0)).count() == 0
