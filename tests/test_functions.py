import hashlib

import pytest
from pyspark.sql import functions as F

from pagedelta.functions import page, text, textdiff


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize("raw", ["", "  A\t b\n", "Ünïcode Space　x\x1c\x85y", "a" * 10])
def test_normalize_matches_python(spark, raw):
    assert one(spark, text.normalize_text(F.col("x")), x=raw) == " ".join(raw.lower().split())


def test_word_count_and_hash(spark):
    assert one(spark, text.word_count(F.col("x")), x="") == 0
    assert one(spark, text.word_count(F.col("x")), x="a b c") == 3
    assert one(spark, text.content_hash(F.col("x")), x="") == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    "raw", ["", "One. Two! Three? four", "x" * 200 + ". b", " ".join(["word"] * 60) + ". Tail.", "  lead. trail  ", "A.B c. \n d"]
)
def test_sentences_match_python(spark, raw):
    assert one(spark, text.sentences(F.col("x")), x=raw) == textdiff.split_sentences(raw)


@pytest.mark.parametrize(
    ("a", "b", "trivial"),
    [
        ("https://x.org/a", "https://x.org/a/", True),
        ("https://x.org/a", "https://www.x.org/A", True),
        ("http://x.org/a", "https://x.org/a", False),
        ("https://x.org/a", "https://x.org/b", False),
    ],
)
def test_trivial_redirects(spark, a, b, trivial):
    assert one(spark, text.is_trivial_redirect(F.col("a"), F.col("b")), a=a, b=b) is trivial


def test_url_parts_keep_the_port(spark):
    assert one(spark, text.netloc(F.col("u")), u="https://x.org:8080/p?q") == "x.org:8080"
    assert one(spark, text.netloc(F.col("u")), u="not a url") is None


def test_change_id(spark):
    want = "chg_" + hashlib.md5(b"t:d:u:title").hexdigest()[:12]
    assert one(spark, text.change_id(F.col("t"), F.col("d"), F.col("u"), "title"), t="t", d="d", u="u") == want


def test_week_begins_on_sunday(spark):
    for day, want in (("2024-01-13", "2024-01-07"), ("2024-01-14", "2024-01-14")):
        assert str(one(spark, text.week_key(F.col("t").cast("timestamp")), t=day)) == want


def test_diff_cases():
    assert textdiff.text_diff("", "") == ([], [], "No content available")
    assert textdiff.text_diff("", "Hi. You.") == (["Hi.", "You."], [], "Content captured (2 words)")
    assert textdiff.text_diff("Gone now.", None) == ([], ["Gone now."], "Content removed")
    added, removed, said = textdiff.text_diff("Same one here. Old sentence is here.", "Same one here. New sentence is here.")
    assert (added, removed) == (["New sentence is here."], ["Old sentence is here."])
    assert said == "1 section(s) added, 1 section(s) removed"
    assert textdiff.text_diff("A. B.", "A. C.")[2] == "Minor text changes detected"  # short sentences do not count
    many = " ".join(f"Added sentence number {i} is long {'x' * 200}." for i in range(9))
    added, _, said = textdiff.text_diff("Start of it all.", "Start of it all. " + many)
    assert said == "5 section(s) added" and len(added) == 5 and max(map(len, added)) <= 150
    assert textdiff.text_diff("--- one old sentence.", "+++ one new sentence.")[2] == "Minor text changes detected"


HTML = """<html><head><title> The title </title><meta name="description" content=" About "><meta name="robots" content="NoIndex,follow">
<link rel="canonical nofollow" href=" https://x.org/a "><script type="application/ld+json">{"@type":["Article","NewsArticle"]}</script>
<script type="application/ld+json">[{"@type":"FAQPage"},{"x":1}]</script><script type="application/ld+json">{bad</script>
<script type="application/ld+json">{"@graph":[{"@type":"No"}]}</script></head><body><div class="header-bar">gone</div><header><h1>Site <b>name</b></h1></header>
<main><h1>Head</h1><p>One<p>Two &amp; three<div id="toc"><p>gone</p></div><aside>gone</aside><form>gone</form></main><footer>gone</footer></body>"""


def test_page_signals():
    title, description, h1, noindex, canonical, schemas, body = page.read_page(HTML)
    assert (title, description, canonical, noindex) == ("The title", "About", "https://x.org/a", True)
    assert h1 == ["Sitename", "Head"]
    assert schemas == ["Article", "NewsArticle", "FAQPage"]
    assert body == "Head One Two & three"


def test_class_substrings_strip():
    assert page.read_page("<body><div class='loading'>gone</div><p>kept</p></body>")[6] == "kept"  # "ad" is in "loading"


@pytest.mark.parametrize("html", [None, "", "%PDF-1.4 \x00\x01", "<p>a<b>b", "</div></p><li>x", "<" * 50])
def test_odd_pages_do_not_fail(html):
    assert len(page.read_page(html)) == 7


def test_extract_equals_quick_route(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("domain", F.lit("d"))
    got = page.extract(pages).join(pages.select("url", F.sha2(page.quick_text(F.col("html")), 256).alias("quick")), "url")
    assert got.filter("content_hash <> quick").count() == 0


def test_json_ld_types(spark):
    for doc, want in (('{"@type":"A"}', ["A"]), ('{"@type":["A","B"]}', ["A", "B"]), ('[{"@type":"A"},{"@type":["B"]}]', ["A", "B"]), ("{bad", []), ("{}", [])):
        assert one(spark, page.json_ld_types(F.col("x")), x=doc) == want
