"""The state by domain: what a run writes, what it refers to, what a vacuum deletes and leaves."""

from datetime import datetime

from pyspark.sql import functions as F
from test_damage import answers, config, run, site
from test_runs import Dies
from test_sources import PAGE

from pagedelta import schemas
from pagedelta.operators.run import crawl
from pagedelta.sources import store as S
from pagedelta.sources.store import Store, total_urls


def pages(spark, domains, title):
    row = lambda d, i: (d, f"https://{d}/{i}", datetime(2024, 1, 1), datetime(2024, 1, 1), "h", title, "", "", [], 1, "", [], None, 0)
    return spark.createDataFrame([row(d, i) for d in domains for i in range(2)], schemas.PAGE_STATE)


def saved(spark, store, state, kept=(), day=1):
    sites = spark.createDataFrame([(d, d.upper(), 0) for d in (f"s{i}.org" for i in range(40))], schemas.SITES)
    return store.save(spark.createDataFrame([], schemas.CHANGES), state, lambda rows: total_urls(rows, sites), datetime(2024, 1, day), kept)


def folders(tmp_path, run):
    at = tmp_path / "s" / "pages" / f"run={run}"
    return sorted(p.name.removeprefix("domain=") for p in at.iterdir() if p.name.startswith("domain=")) if at.exists() else []


def test_a_run_writes_the_domains_that_it_changed(spark, tmp_path):
    store, domains = Store(spark, f"file://{tmp_path}/s"), [f"s{i}.org" for i in range(40)]
    saved(spark, store, pages(spark, domains, "one"))
    saved(spark, store, pages(spark, ["s7.org"], "two"), [d for d in domains if d != "s7.org"], 2)
    assert folders(tmp_path, 2) == ["s7.org"] and len(folders(tmp_path, 1)) == 40
    state = store.load_state()
    assert state.columns == [c.split()[0] for c in schemas.PAGE_STATE.split(", ")]
    assert {(r.title, r["count"]) for r in state.groupBy("title").count().collect()} == {("one", 78), ("two", 2)}
    assert store.load_sites().agg(F.sum("total_urls_discovered")).first()[0] == 80
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan and "run#" in plan.split("PartitionFilters: ")[1].split("], ")[0]


def test_a_vacuum_leaves_what_runs_and_leases_refer_to(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    saved(spark, store, pages(spark, ["s1.org", "s2.org", "a%2Fb=c:d"], "1"))
    with store.lease() as leased:
        for day in (2, 3, 4):
            saved(spark, store, pages(spark, ["s1.org"], str(day)), ["s2.org", "a%2Fb=c:d"], day)
        assert store.vacuum() == ["manifest/run=2", "sites/run=2", "pages/run=2"]
        assert {r.title for r in store.load_state(leased).collect()} == {"1"}
    assert store.vacuum() == ["manifest/run=1", "sites/run=1", "pages/run=1/domain=s1.org"] and store.vacuum() == []
    assert sorted((r.domain, r.title) for r in store.load_state().collect()) == sorted([("s1.org", "4"), ("s2.org", "1"), ("a%2Fb=c:d", "1")] * 2)
    with store.lease(seconds=-5):
        saved(spark, store, pages(spark, ["s1.org"], "5"), ["s2.org"], 5)
        assert "sites/run=3" in store.vacuum(1) and store.load_state().count() == 4
    assert folders(tmp_path, 1) == ["s2.org"] and not list((tmp_path / "s" / "leases").glob("run*"))


def test_a_vacuum_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    for day in (1, 2, 3):
        saved(spark, store, pages(spark, ["s1.org"], str(day)), day=day)
    saved_fs, n = Store._fs, 0

    class Stops:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def delete(self, *args):
            nonlocal n
            n += 1
            if n == 2:
                raise Dies
            return self.fs.delete(*args)

    monkeypatch.setattr(Store, "_fs", lambda self, path: (Stops(saved_fs(self, path)[0]), saved_fs(self, path)[1]))
    try:
        store.vacuum()
        raise AssertionError
    except Dies:
        pass
    monkeypatch.setattr(Store, "_fs", saved_fs)
    assert {r.title for r in store.load_state().collect()} == {"3"}
    assert store.vacuum() == ["sites/run=1", "pages/run=1"] and folders(tmp_path, 2) == ["s1.org"]


def test_sites_that_fail_or_are_not_named_any_more_are_not_written(spark, tmp_path):
    page = lambda n, head="": f"<html><head>{head}</head>" + PAGE.format(f"T{n}", f"Text {n}.")
    a, b = ({f"https://{d}/{i}": page(i) for i in range(2)} for d in ("a.org", "b.org"))
    store = Store(spark, f"file://{tmp_path}/s")
    before, _ = run(spark, store, config("a.org", "b.org"), site("a.org", a) | site("b.org", b), 1)
    crawl(store, config("a.org"), datetime(2024, 1, 2), answers(site("a.org", a)), lambda seconds: None)
    assert folders(tmp_path, 2) == ["a.org"] and folders(tmp_path, 1) == ["a.org", "b.org"]
    state = {(r.domain, r.url): r for r in store.load_state().collect()}
    assert {k: r for k, r in state.items() if k[0] == "b.org"} == {k: r for k, r in before.items() if k[0] == "b.org"}
    assert all(r.last_seen == datetime(2024, 1, 2) for k, r in state.items() if k[0] == "a.org")


def test_names_of_folders():
    assert S._unescaped("a%252Fb%3Dc%3Ad") == "a%2Fb=c:d" and S._unescaped("__HIVE_DEFAULT_PARTITION__") is None and S._run_of("_temporary") == 0
