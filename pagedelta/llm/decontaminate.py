"""Benchmark decontamination by winnowing.

A span of ``SPAN`` words holds ``SPAN - GRAM + 1`` grams of ``GRAM`` words. Both sides keep, of every run of so many grams,
those with the least hash. Any shared span therefore shares a kept gram at the same place in it; the join on kept grams
finds it, and comparing the words around the gram extends the hit to its true ends. Hashes only propose: every hit is
confirmed word by word.

Items shorter than ``SPAN`` words have one window, the item itself; grams of exactly their length stand in for the kept
grams, since a shorter window need not hold one.

Before a document's grams are compared with their neighbours, a bit table of the benchmark's kept grams drops those that
cannot join. It has a bounded size; when a benchmark overfills it, more grams reach the join and the result is the same.
The benchmark index is broadcast while it has at most ``BROADCAST_ROWS`` rows and joined through a shuffle beyond that.

Defined results: a null or wordless text has no words, no hits and is clean; null or wordless items have no windows; an
item without an id can cause hits but is not counted; repeated rows are judged one by one; only the id and text columns
are read; empty tables give an empty, or an all-clean, result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPAN = 13
GRAM = 5
RUN = SPAN - GRAM + 1
BROADCAST_ROWS = 200_000
MAX_TABLE_BITS = 1 << 22
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of any non-ASCII characters, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BREAKS), "")


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(words[i + j] for j in range(k)))


def _grams(words: str, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: _gram(F.col(words), i, k))).otherwise(
        F.array().cast("array<bigint>")
    )


def _is_kept(grams: Column, i: Column) -> Column:
    """Whether gram ``i`` has the least hash of a run of ``RUN`` grams around it."""
    first, last = F.greatest(i - RUN + 1, F.lit(0)), F.least(i, F.size(grams) - RUN)
    return F.exists(F.sequence(first, last), lambda s: F.array_min(F.slice(grams, s + 1, RUN)) == grams[i])


def _context(words: Column, i: Column, k: int, around: int) -> Column:
    """The gram at ``i`` with the words that a span holding it can reach."""
    left = F.least(i, F.lit(around))
    return F.struct(
        _gram(words, i, k).alias("fp"),
        F.lit(k).alias("k"),
        i.alias("at"),
        left.alias("left"),
        F.slice(words, i - left + 1, left + k + around).alias("ctx"),
    )


def _contexts(at: Column, words: Column, k: int, around: int) -> Column:
    return F.transform(at, lambda i: _context(words, i, k, around))


def _only_kept(at: Column, grams: Column) -> Column:
    return F.filter(at, lambda i: _is_kept(grams, i))


_NO_HITS = "array<struct<fp:bigint,k:int,at:int,left:int,ctx:array<string>>>"


def _none() -> Column:
    return F.array().cast(_NO_HITS)


def benchmark_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """fp, k, left, ctx, item_id of every kept gram of the items."""
    rows = items.select(F.col(id_col).alias("item_id"), item_words(F.col(text_col)).alias("words"))
    rows = rows.withColumn("grams", _grams("words", GRAM))
    n, words, grams = F.size("words"), F.col("words"), F.col("grams")
    kept = _only_kept(F.sequence(F.lit(0), F.size("grams") - 1), grams)
    found = F.when(n >= SPAN, _contexts(kept, words, GRAM, SPAN - GRAM))
    for k in range(1, SPAN):
        found = found.when(n == k, F.array(_context(words, F.lit(0), k, 0)))
    return (
        rows.select("item_id", F.explode(found.otherwise(_none())).alias("g"))
        .select("g.fp", "g.k", "g.left", "g.ctx", "item_id")
        .distinct()
    )


def _bit_table(index: DataFrame, n_rows: int) -> tuple[Column, int]:
    """The index's fingerprints as an array of 64-bit words, at most ``MAX_TABLE_BITS`` bits, and its bit count."""
    bits = 1 << 12
    while bits < 64 * n_rows and bits < MAX_TABLE_BITS:
        bits *= 2
    slot = F.col("fp").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    got = index.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(one).alias("b")).collect()
    filled = {r["w"]: r["b"] for r in got}
    text = ",".join(str(filled.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>"), bits


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_words, spans (start and end word of each hit, merged), items (ids), n_hit."""
    index = benchmark_index(items)
    lengths = {r["k"]: r["n"] for r in index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(lengths.values())
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        item_words(F.col(text_col)).alias("words"),
    )
    hits = _none()
    if n_rows:
        table_, bits = _bit_table(index, n_rows)
        words = F.col("words")

        def may_join(h: Column) -> Column:
            slot = h.bitwiseAND(F.lit(bits - 1))
            word = table_[F.shiftright(slot, 6).cast("int")]
            return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        found = []
        for k in sorted(lengths):
            # GRAM doubles as the length of some short items: those must look at every gram, kept or not.
            name = f"grams{k}"
            rows = rows.withColumn(name, _grams("words", k))
            grams = F.col(name)
            at = F.filter(F.transform(grams, lambda h, i: F.when(may_join(h), i)), lambda i: i.isNotNull())
            short = _contexts(at, words, k, 0)
            if k == GRAM:
                full = _contexts(_only_kept(at, grams), words, GRAM, SPAN - GRAM)
                full = F.when(F.size("words") >= SPAN, full).otherwise(_none())
                # Short items of GRAM words: their context is the gram alone, so one list of every gram serves both.
                short_fives = index.filter((F.col("k") == GRAM) & (F.size("ctx") == GRAM)).limit(1).count()
                found.append(F.concat(full, short) if short_fives else full)
            else:
                found.append(short)
        hits = F.when(F.size("words") > 0, F.concat(*found)).otherwise(_none())
    rows = rows.select("row", "doc_id", F.size("words").cast("bigint").alias("n_words"), F.explode_outer(hits).alias("g"))
    rows = rows.select("row", "doc_id", "n_words", "g.*")
    bench = index.select(
        "fp", F.col("k").alias("bk"), F.col("left").alias("bleft"), F.col("ctx").alias("bctx"), "item_id"
    )
    if n_rows <= BROADCAST_ROWS:
        bench = F.broadcast(bench)
    else:  # rows without a gram would all meet in one task
        rows = rows.withColumn("fp", F.coalesce("fp", F.xxhash64("row")))
    joined = rows.join(bench, "fp", "left")
    a, b, al, bl, k = F.col("ctx"), F.col("bctx"), F.col("left"), F.col("bleft"), F.col("k")

    def run(n: Column, same) -> Column:
        """How many of the first ``n`` comparisons hold before one fails."""
        bad = F.array_position(F.transform(F.sequence(F.lit(1), n), same), False).cast("int")
        return F.when(n < 1, F.lit(0)).when(bad == 0, n).otherwise(bad - 1)

    core = (k == F.col("bk")) & (F.slice(a, al + 1, k) == F.slice(b, bl + 1, k))
    back = run(F.least(al, bl), lambda j: a[al - j] == b[bl - j])
    ahead = run(F.least(F.size(a) - al, F.size(b) - bl) - k, lambda j: a[al + k + j - 1] == b[bl + k + j - 1])
    need = F.when((F.size(b) == k) & (bl == 0), k).otherwise(F.lit(SPAN))
    joined = joined.withColumn("core", core).withColumn("back", F.when(F.col("core"), back))
    joined = joined.withColumn("ahead", F.when(F.col("core"), ahead))
    whole = F.col("core") & (F.col("back") + k + F.col("ahead") >= need)
    span = F.struct((F.col("at") - F.col("back")).alias("start"), (F.col("at") + k + F.col("ahead")).alias("end"))
    per_doc = joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(whole, span))).alias("hits"),
        F.array_sort(F.collect_set(F.when(whole, F.col("item_id").cast("string")))).alias("items"),
    )
    spans = F.aggregate(
        "hits",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return per_doc.select("doc_id", "n_words", spans.alias("spans"), "items").withColumn(
        "n_hit",
        F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).cast("bigint"),
    )


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_W = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{BREAKS}'), lambda x: x <> '')"
)
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, {_W} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM
  (SELECT item_id, w, least({SPAN}, len(w)) AS k, unnest(range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)) AS s
   FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM
  (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN ks ON len(w) >= k)),
m AS (SELECT dw.r, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM
  (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""
