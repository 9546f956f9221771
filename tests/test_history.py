"""A history in one pass equals its runs one after the other."""

import random
from datetime import datetime, timedelta

import pytest
from oracle import rows as plain

from pagedelta import schemas
from pagedelta.operators import changes as C
from pagedelta.operators.history import history_changes

SITES = [("a.org", "A", 0), ("b.org", "B", 0), ("c.org", "C", 0)]


def made(seed, n_runs=5):
    """Rows of crawls, extracts, feeds and statuses, by run, with failed crawls, case changes, returns and pages not read."""
    rng = random.Random(seed)
    urls, extracts, feeds, statuses = [], [], [], []
    pool = {d: [f"https://{d}/{p}{i}" for i in range(9) for p in ("p/", "P/")] for d, _, _ in SITES}
    for run in range(1, n_runs + 1):
        for d, some in pool.items():
            share = rng.choice((0.8, 0.8, 0.7, 0.2, 0.0 if d == "c.org" else 0.9))
            for k, u in enumerate(u for u in some if rng.random() < share):
                urls += [(run, d, u, rng.choice((None, "", "2024")), rng.choice(("", "Feed")), "sitemap", k)] * rng.choice((1, 1, 2))
                if rng.random() < 0.8:
                    h = rng.choice(("x", "y", ""))
                    extracts.append((run, d, u, h, rng.choice(("", "T1", "T2")), rng.choice(("", "M1", "M2")), rng.choice(([], ["H"], ["H", "I"])), rng.choice((0, 9, 60)), "", rng.choice(([], ["S"], ["S", "R"])), f"Text of {h}. And more of it here." * bool(h), False))
                if rng.random() < 0.2:
                    feeds.append((run, d, u, "F", "Mon", "s"))
            statuses += [(run, u, *rng.choice(((404, None), (301, u + "/new"), (301, u + "/"))), rng.random() < 0.5, None) for u in some if rng.random() < 0.7]
    return urls, extracts, feeds, statuses


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("threshold", [1, 2])
def test_one_pass_equals_run_by_run(spark, seed, threshold):
    n = 5
    ddl = [schemas.DISCOVERED, schemas.PAGE_EXTRACT, schemas.FEED_ENTRY, schemas.URL_STATUS]
    tables = [spark.createDataFrame(rows, "run int, " + d).coalesce(1) for rows, d in zip(made(seed + 10 * threshold, n), ddl)]
    runs = [(r, datetime(2024, 1, 1) + timedelta(days=r)) for r in range(1, n + 1)]
    sites = spark.createDataFrame(SITES, schemas.SITES)
    state, want = spark.createDataFrame([], schemas.PAGE_STATE), []
    for run, ts in runs:
        of = [t.filter(f"run = {run}").drop("run") for t in tables]
        events, state = C.detect_changes(state, of[0], of[1], of[2], of[3], sites, ts, run == 1, threshold, 2)
        state = spark.createDataFrame(state.toArrow().to_pylist(), schemas.PAGE_STATE).coalesce(1)
        want += events.selectExpr(f"{run} AS run", "*").toArrow().to_pylist()
    got, last = history_changes(spark.createDataFrame(runs, schemas.RUNS), *tables, sites, threshold, 2)
    key = lambda r: (r["run"], r["domain"], r["url"], r["change_type"], r["id"], str(r["details"]))
    got = got.toArrow().to_pylist()
    assert sorted(got, key=key) == sorted(want, key=key) and len({r["change_type"] for r in got}) >= 7
    assert plain(last.toPandas()) == plain(state.toPandas())


def test_a_history_of_one_run_or_none(spark):
    tables = [spark.createDataFrame(rows, "run int, " + d) for rows, d in zip(made(3, 1), [schemas.DISCOVERED, schemas.PAGE_EXTRACT, schemas.FEED_ENTRY, schemas.URL_STATUS])]
    sites = spark.createDataFrame(SITES, schemas.SITES)
    got, state = history_changes(spark.createDataFrame([(1, datetime(2024, 1, 1))], schemas.RUNS), *tables, sites)
    assert got.count() == 0 and state.count() == tables[0].select("domain", "url").distinct().count()
    got, state = history_changes(spark.createDataFrame([], schemas.RUNS), *(t.limit(0) for t in tables), sites)
    assert got.count() == 0 and state.count() == 0
