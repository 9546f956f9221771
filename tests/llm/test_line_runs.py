"""Line deduplication against its words, on real rows, on odd ones and in batches."""

import hashlib
from collections import Counter, defaultdict

import pytest
from oracle import same, views
from pyspark.sql import functions as F
from test_operators import ODD, ODD_ROWS

from pagedelta.llm import line_runs
from pagedelta.llm.common import SPACES

LONG = "This line is long enough to be judged, it has more than forty code points"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    low = float("-inf")
    last = {k: max(v, key=lambda i: low if i is None else i) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def check(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in line_runs.deduplicated(docs, **settings).collect())
    assert got == brute(rows, **{k: v for k, v in settings.items() if k != "batches"})
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    same(line_runs.op13_line_dedup(spark, sf_dir).toPandas(), views(sf_dir).execute(line_runs.OP13_SQL).df())


def test_lines_of_five_documents_stay_in_the_last_alone(spark):
    rows = [(i, f"head {i}\n{LONG}\n  {LONG.upper()}\t\n\nshort") for i in range(5)] + [(9, f"{LONG} four\n{LONG}!"), (2**63 - 1, LONG), (-(2**63), LONG)]
    got = check(spark, rows)
    assert sum(n * k[3] for k, n in got.items()) == 5 * 2 + 1
    check(spark, rows, min_docs=8)
    check(spark, rows, min_docs=9)
    check(spark, rows, min_docs=1, min_chars=5)


def test_repeated_rows_nulls_and_rows_without_an_id(spark):
    same_id = [(7, LONG), (7, LONG), (7, f"x\n{LONG}"), (None, LONG), (None, f"{LONG}\ny"), (1, LONG), (2, LONG)]
    assert all(k[3] == 0 for k in check(spark, same_id))
    check(spark, [*same_id, (3, None), (3, ""), (4, LONG), (5, f"{LONG}\n{LONG}")])
    check(spark, [(None, LONG)] * 9)


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_number_of_batches_does_not_matter(spark, batches):
    rows = [(i, "\n".join(f"{LONG} {(i * j) % 11}" for j in range(1, 6))) for i in range(60)]
    check(spark, rows, batches=batches)


def test_long_texts_and_none(spark):
    many = "\n".join(f"{LONG} {i}" for i in range(20_000))
    check(spark, [(i, many) for i in range(5)])
    docs = spark.createDataFrame(ODD_ROWS, ODD)
    assert line_runs.deduplicated(docs).count() == len(ODD_ROWS)
    assert line_runs.deduplicated(docs.limit(0)).count() == 0


def test_runs_hold_each_key_once_and_are_merged_by_level(spark):
    store = line_runs.LineRuns(spark, fanout=2)
    rows = spark.createDataFrame([(i, f"{LONG} {i // 2}\n{LONG} {i}") for i in range(40)], "doc_id long, text string")
    keyed = line_runs.keyed_lines(rows)
    for b in range(5):
        store.add(keyed.filter(F.col("doc_id") % 5 == b))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    held = [tuple(r) for run in store.runs() for r in run.select("h1", "h2").collect()]
    assert len(held) == len(set(held)) == keyed.select("h1", "h2").distinct().count()
    total = {tuple(r) for r in keyed.groupBy("h1", "h2").agg(F.countDistinct("doc_id"), F.max("doc_id")).collect()}
    assert {tuple(r) for r in store.frequent(1).collect()} == total


def test_joins_with_runs_shuffle_the_batch_alone(spark):
    store = line_runs.LineRuns(spark)
    rows = spark.createDataFrame([(i, f"{LONG} {i}") for i in range(40)], "doc_id long, text string")
    keyed = line_runs.keyed_lines(rows)
    run = store.add(keyed.filter("doc_id < 20"))
    with line_runs._planned(spark):
        plan = store.add(keyed.filter("doc_id >= 20")).join(run.hint("merge"), line_runs.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_digest_of_no_lines_is_that_of_the_empty_text(spark):
    docs = spark.createDataFrame([(i, LONG) for i in range(5)], "doc_id long, text string")
    out = line_runs.deduplicated(docs).filter("n_dropped = 1").select(F.sha2("text", 256)).distinct().collect()
    assert [r[0] for r in out] == [hashlib.sha256(b"").hexdigest()]
