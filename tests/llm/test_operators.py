"""Each operator against brute force or its SQL, on real rows and on odd ones."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from oracle import same, views
from pyspark.sql import functions as F

from pagedelta.llm import decontaminate, packing, pii, quality_ranker, quality_rules, registry, simhash, suffix_dedup, toxicity, warc, wrapper
from pagedelta.llm.common import crc_bucket, table

ODD = "doc_id long, text string, lang string, words string, fp long, hits string, n_chars long"
ODD_ROWS = [
    (1, None, None, "x", 7, "h", None),
    (2, "", "en", None, None, None, 0),
    (3, " \t\n\x0b ", "en", None, None, None, 5),
    (None, "no id here", None, None, None, None, None),
    (4, "same words here and there again and again", "en", None, None, None, 1),
    (4, "same words here and there again and again", "en", None, None, None, 1),
    (5, "same words here and there again and again", "de", None, None, None, 1),
    (6, "w " * 30_000, "en", None, None, None, 60_000),
    (7, "é" * 20_000, "fr", None, None, None, 20_000),
    (8, "a@b.co", "en", None, None, None, 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), views(sf_dir).execute(registry.ORACLES[name]).df())


# ---------------------------------------------------------------- 1


def held_out(spark, sf, query, label, mod, rest):
    got = registry.QUERIES[query](spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", label)
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert got.count() == table(spark, sf, "documents").count()
    assert got.filter(F.col("held_out") != (crc_bucket(F.col("doc_id"), mod) == rest)).count() == 0
    assert rows["score"].between(0, 1).all()
    return rows


def test_ranker_on_held_out_rows(spark):
    rows = held_out(spark, "/root/testdata/sf0.01", "op1_quality_ranker", "quality", 4, 2)
    assert (rows["predicted"] == rows["quality"]).mean() >= 0.95
    assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_pairs_order_and_threshold():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.8).astype(int)
    x = np.c_[y + rng.normal(0, 0.05, 400), rng.normal(0, 1, 400)]
    ranker = quality_ranker.fit_pairs(x, y)
    strength = ((x - ranker.mean) / ranker.scale) @ np.array(ranker.weights)
    assert strength[y == 1].min() > strength[y == 0].max()
    assert (strength > ranker.cut).sum() == y.sum()


def test_ranker_on_odd_rows(spark, odd, none):
    one_class = spark.createDataFrame([(4, 1), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    ranker = quality_ranker.fit(odd, one_class)
    assert [r.score for r in quality_ranker.score(odd, ranker).collect()] == [0.5] * len(ODD_ROWS)
    ranker = quality_ranker.fit(odd, spark.createDataFrame([(4, 1), (6, 0), (6, None)], "doc_id long, quality int"))
    got = quality_ranker.score(odd, ranker).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_ranker.score(none, ranker).count() == 0


# ---------------------------------------------------------------- 2

PAGE = (
    "<html><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><main><div class='cookie-notice'>We use cookies</div><article><h1>Head {0}</h1>"
    "<p>One &amp; <b>two</b>\n  {0}.<p>Three<br>four<div class=ad>Buy</div><aside>Side</aside><form>Mail</form><p class=kicker>Written by us</p>"
    "<section id=comments><p>Nice {0}</p></section></article></main><footer>&copy; us</footer></body></html>"
)


def test_main_text(spark):
    rows = [(i, f"https://a.org/{i}", PAGE.format(i)) for i in range(4)] + [(9, None, PAGE.format(9)), (10, "https://b.org/x", None), (11, "bad url", "<p>x"), (None, "https://b.org/y", "")]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Head 0\nOne & two 0.\nThree four"  # what all pages of the host say alike is template
    assert got[9] == "Head 9\nOne & two 9.\nThree four\nWritten by us"
    assert (got[10], got[11], got[None]) == ("", "x", "")
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_align():
    a = wrapper.wrap(wrapper.blocks("<div><h1>A</h1><p>x<p>y<p>z</div><ul><li>m</ul>"))
    b = wrapper.wrap(wrapper.blocks("<div><h1>B</h1><h2>Sub</h2><p>x</div><ul><li>m</ul>"))
    both = wrapper.align(a, b)
    assert [(n[0], n[1], n[2]) for n in both["nodes"]] == [("/div/h1", False, False), ("/div/h2", False, True), ("/div/p", True, False), ("/ul/li", False, False)]
    assert "(/div/h1 #)" in wrapper.expression(both) and "(/div/p #)+" in wrapper.expression(both)
    assert wrapper.align(b, a)["n"] == 2 and json.dumps(wrapper.align(both, a))
    grouped = wrapper.wrap(wrapper.blocks("<dl>" + "<dt>t<dd>d" * 4 + "</dl>"))
    assert [n[0] for n in grouped["nodes"]] == ["/dl/dt", "/dl/dd"]


@pytest.mark.parametrize("html", ["<", "<p", "<!--", "<script>x", "</p></div>", "<a b='", "\x00<p>\x00", "<p>" * 2000, "&#xD800;&#1114112;&amp"])
def test_odd_html_does_not_fail(html):
    assert isinstance(wrapper.chosen(wrapper.blocks(html)), list)


def test_article_text_of_the_pages_table(spark, sf_dir):
    import html as entities

    rows = wrapper.main_text(table(spark, sf_dir, "pages")).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<br>|<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(p for p in parts if p)


# ---------------------------------------------------------------- 3


def test_archives_are_deterministic_and_complete(spark, tmp_path):
    long = "x" * 1500
    rows = [(i, f"https://a.org/{i}", f"page {i} " * (i % 50)) for i in range(120)]
    rows += [(1000 + i, "https://b.org", long) for i in range(30)] + [(5 * 10**12, None, long), (None, "c\n d", "é" * 600), (7, "u", ""), (8, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = {}
    for k in (1, 3):
        root = f"file://{tmp_path}/w{k}"
        manifest = warc.write_archive(pages.repartition(k), root, 3000, 1500)
        assert manifest.agg(F.sum("records")).first()[0] == len(rows)
        files[k] = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / f"w{k}").glob("*.gz")}
        assert not (tmp_path / f"w{k}" / "_temporary").exists()
    assert files[1] == files[3] and len(files[1]) > 5
    assert files[1] == {r["name"]: r["sha256"] for r in manifest.collect()}
    got = warc.read_archive(spark, root).collect()
    responses = {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"}
    assert {(a, c or "") for a, _, c in rows if c != long} | {(5 * 10**12, long)} == responses
    assert all(r.refers_to == 5 * 10**12 and r.payload_bytes == 1500 for r in got if r.record_type == "revisit")
    damaged = next((tmp_path / "w3").glob("*.gz"))
    damaged.write_bytes(damaged.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut off|Error"):
        warc.read_archive(spark, root).collect()


def test_empty_archive(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), root)
    assert warc.read_archive(spark, root).count() == 0


# ---------------------------------------------------------------- 4


def test_machine_on_held_out_rows(spark):
    rows = held_out(spark, "/root/testdata/sf0.1", "op4_toxicity", "toxic", 5, 0)
    assert (rows["predicted"] == rows["toxic"]).mean() >= 0.97


def test_machine_learns_interactions():
    import pandas as pd

    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + list(rng.integers(10, 4000, 3)), np.int64))
        y.append(float(a and b))
    machine = toxicity.fit_machine(pd.Series(rows), np.array(y))
    alone, both = machine.score(pd.Series([np.array([1]), np.array([2]), np.array([], np.int64)])), machine.score(pd.Series([np.array([1, 2])]))
    assert both[0] > 0.9 and alone.max() < 0.1


def test_machine_on_odd_rows(spark, odd, none):
    machine = toxicity.fit(odd, spark.createDataFrame([(4, 1), (6, 0), (6, None), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.with_score(odd, machine, "s")
    assert got.columns == [*odd.columns, "s"] and got.filter("s between 0 and 1").count() == len(ODD_ROWS)
    assert toxicity.with_score(none, machine).count() == 0
    assert toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int")).score is not None


# ---------------------------------------------------------------- 5


def test_decontamination_with_short_and_odd_items(spark, docs, odd, none):
    from pagedelta.llm.decontaminate import OP5_SQL

    items = [(1, "Eaea ndorea as erthndly"), (2, None), (3, "--"), (None, "the and"), (5, "the and attion to thanedble"), (7, "The of"), (7, "The of"), (9, " ".join(["again and"] * 9))]
    first = docs.orderBy("doc_id").first().text.split()
    items += [(20, " ".join(first[3:16])), (21, " ".join(first[3:15])), (22, " ".join(first[10:60]))]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    con = views("/root/testdata/sf0.001")
    import pandas as pd

    con.register("d_", rows.toPandas())
    con.register("b_", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM d_")
    con.execute("CREATE OR REPLACE VIEW benchmark AS SELECT * FROM b_")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        held, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, limit
        got = decontaminate.contamination(rows, bench).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))
        decontaminate.BROADCAST_ROWS = held
        same(got.toPandas(), con.execute(OP5_SQL).df())
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).filter(decontaminate.is_contaminated()).count() == 0


# ---------------------------------------------------------------- 6


def check_packing(got, want_ids, window):
    """Every id of every document lies in one piece, sequences are gapless, and only powers of two fall short."""
    used = {}
    for r in got:
        used.setdefault(r.doc_id, []).append(r)
        assert 1 <= r.length <= window
    for doc_id, ids in want_ids.items():
        assert sum(r.length for r in used[doc_id]) == len(ids)
        for r in used[doc_id]:
            assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= window and (end == window or end & (end - 1) == 0)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = packing.default_tokenizer()
    plain = Tokenizer.from_file(tokenizer)
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "<|endoftext|> x 　 'll  \n\n 12ab"), (10**6 + 3, "a" * 3000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want = {r.doc_id: np.append(plain.encode(r.text or "", add_special_tokens=False).ids, 0).astype("<u4") for r in rows.collect()}
    for window in (1024, 64):
        check_packing(packing.pack(rows, tokenizer, window).collect(), want, window)
    digest = packing.digest(packing.pack(rows, tokenizer)).collect()
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in digest)


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, packing.default_tokenizer()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD_ROWS}
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("hist", [{700: 1000}, {512: 3}, {1: 5000}, {1000: 50, 24: 49}, {341: 10, 342: 20, 300: 7}])
def test_plan_stays_within_the_counts(hist):
    h = np.zeros(1025, np.int64)
    for k, n in hist.items():
        h[k] = n
    combos, left = packing.plan(h)
    used = np.zeros(1025, np.int64)
    for parts, n in combos:
        assert sum(parts) == 1024
        for p in parts:
            used[p] += n
    assert ((used + left) == h).all() and (left >= 0).all()


# ---------------------------------------------------------------- 7

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def test_detectors_equal_the_patterns(docs):
    import random

    random.seed(5)
    texts = [r.text or "" for r in docs.collect()]
    texts += ["".join(random.choice("ab1.234@+ -()é%") for _ in range(50)) for _ in range(4000)]
    parts = ["4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.co", "@", ".", "1.2.3.4", "256", "-", " ", "+"]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(0, 8))) for _ in range(3000)]
    for t in texts:
        want = {k: [m.span() for m in re.finditer(p, t) if passes(k, m[0])] for k, p in BASE.items()}
        assert {k: f(t) for k, f in pii.DETECTORS.items()} == want
        assert {(k, a, b) for k, v in want.items() for a, b in v} <= {x[:3] for x in pii.find(t)}


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail bob at example dot com", "email", "bob at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card ４111 1111 1111 1111.", "card", "４111 1111 1111 1111"),
        ("call five five five one two three four five six seven", "phone", "five five five one two three four five six seven"),
        ("at one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("a​b@c​d.com", "email", "a​b@c​d.com"),
    ],
)
def test_disguises(text, kind, found):
    assert [(k, text[a:b], base) for k, a, b, base in pii.find(text)] == [(kind, found, False)]
    assert pii.redact(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at example.com today", "the cat sat at home dot", "one two three", "He is at the dot com"])
def test_prose_is_left_alone(text):
    assert pii.find(text) == []


def test_pii_on_odd_rows(odd, none):
    got = odd.select("doc_id", pii.spans(F.col("text")).alias("s"), pii.redacted(F.col("text")).alias("r")).collect()
    assert len(got) == len(ODD_ROWS) and [r.r for r in got if r.doc_id == 8] == ["[EMAIL]"] and [r.r for r in got if r.doc_id == 1] == [None]
    assert none.select(pii.spans(F.col("text"))).count() == 0


def test_pii_is_linear_in_the_text():
    import time

    began = time.process_time()
    for t in ("1" * 60_000, "+1" + " " * 60_000, "a." * 30_000 + "@", "one 1 dot two " * 4000, "dot at " * 9000, "x@" * 30_000):
        pii.find(t)
    assert time.process_time() - began < 15


# ---------------------------------------------------------------- 8


def brute_fp(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = [(r.doc_id, brute_fp(r.text)) for r in rows.collect()]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(rows).collect()]
    assert sorted(x[:2] for x in got if x[0] is not None) == sorted(x for x in want if x[0] is not None)
    fps = sorted({f for _, f in want})
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {f: new if v == old else v for f, v in label.items()}
    least = {}
    for i, f in want:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    assert all(c == least.get(label[f]) for _, f, c in got) and len(got) == len(want)


@pytest.mark.parametrize("shard", [4096, 16])
def test_links_of_dense_clusters(spark, shard):
    rng = np.random.default_rng(1)
    fps = set()
    for x in rng.integers(0, 2**63, 3):
        for _ in range(120):
            y = int(x)
            for k in rng.integers(0, 63, rng.integers(0, 9)):
                y ^= 1 << int(k)
            fps.add(y)
    f = np.array(sorted(fps), np.uint64)
    label = np.arange(len(f))
    for i in range(len(f)):
        j = np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 4)
        simhash.merge(label, np.full(len(j), i), j)
    got = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in f], "fp long"), 4, shard)).collect()
    assert {r.v: r.root for r in got} == {int(f[i]): int(f[k]) for i, k in enumerate(label) if i != k} and len(got) == len({r.v for r in got})


def test_simhash_of_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0


# ---------------------------------------------------------------- 9


def test_rules_on_odd_rows(odd, none):
    led = quality_rules.ledger(odd)
    got = {r.doc_id: r for r in led.collect()}
    assert led.count() == len(ODD_ROWS) and got[1].n_words == 0 and got[6].n_repeat_words == 30_000 and got[7].n_words == 1
    assert quality_rules.ledger(none).count() == 0
    few = quality_rules.Policy("few", 2, ("few_words",))
    kept = quality_rules.apply_policy(led, few).filter("kept").count()
    row = quality_rules.ablation(led, few).first()
    assert (row.n_failed, row.n_only, row.n_kept_without) == (len(ODD_ROWS) - kept, len(ODD_ROWS) - kept, len(ODD_ROWS))


def test_rules_against_labels(spark, sf_dir):
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.STRICT)
    rows = led.join(table(spark, sf_dir, "labels"), "doc_id").filter("n_words >= 10").toPandas()
    assert (rows["kept"] == (rows["quality"] == 1)).mean() > 0.97


# ---------------------------------------------------------------- 10


def brute_repeats(rows, n=50):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - n + 1) if i is not None else ():
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1) if i is not None else ():
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        out.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch", [2 << 20, 300])
def test_repeats_equal_brute_force(spark, docs, batch, monkeypatch):
    import random

    random.seed(3)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    passages = [" ".join(random.choice(["alpha", "beta", "gamma", "é", "über", "x"]) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(100):
        t = "".join(random.choice(passages)[random.randint(0, 30) : random.randint(60, 200)] if random.random() < 0.4 else str(random.random()) for _ in range(random.randint(0, 6)))
        rows.append((random.choice([i, i, i, None]), t if random.random() < 0.95 else None))
    rows += rows[:10] + [(1000 + i, rows[5][1]) for i in range(8)] + [(5000, "ab" * 400), (4000, "ab" * 300), (6000, "q" * 49), (6001, "q" * 49), (6002, "q" * 50), (6003, "q" * 120)]
    if batch > 1000:
        rows += [(10**6 + r.doc_id, r.text) for r in docs.limit(80).collect()]
    got = suffix_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got), key=str) == brute_repeats(rows)


def test_repeats_of_periodic_texts(spark):
    """One key over a whole text: its 25 bytes have a name below all those of the strings that straddle a separator."""
    import random

    random.seed(5)
    key = "mlwljtfhlxahufpigespyqsof"
    texts = [key + "".join(s + key for s in x) for x in ("AAXAA", "AAYAA", "AAXAAA", "YAAXAAY", "AA", "X")]
    texts += [key + "".join(random.choice("AAAX") + key for _ in range(random.randint(1, 12))) for _ in range(30)]
    rows = [(i, t[random.choice([0, 0, 3]) :]) for i, t in enumerate(texts)]
    got = suffix_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got), key=str) == brute_repeats(rows)


def test_repeats_of_odd_rows(odd, none):
    assert suffix_dedup.repeated(odd).count() == len(ODD_ROWS)
    assert suffix_dedup.repeated(none).count() == 0
