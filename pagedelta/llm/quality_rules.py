"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps the measurements and one 64-bit mask of the rules that failed;
a policy is a versioned mask, so changing a policy, comparing two, or finding out which rule alone drops how many
documents never reads a text again.

Defined results: a null or empty text has no words and fails the base rule and ``few_words``; repeated rows are judged
one by one; a null id stays null; columns other than the id and the text are neither read nor returned, so their names
cannot clash; an empty table gives an empty ledger. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, count_chars, let, table, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a ledger written under an earlier version stays readable.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_word_lines >= 4 AND 10 * n_dup_lines > 3 * n_word_lines"),
    Rule(4, "capitals", "n_letters >= 50 AND 10 * n_capitals > 4 * n_letters"),
    Rule(5, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    Rule(6, "few_letters", "word_chars > 0 AND 10 * n_letters < 3 * word_chars"),
    Rule(7, "exclaims", "10 * n_exclaims > 3 * n_words"),
    Rule(8, "few_distinct_words", "n_words >= 100 AND 100 * n_distinct_words < 10 * n_words"),
    Rule(9, "stutter", "n_words >= 20 AND n_words < 200 AND 10 * n_distinct_words < 4 * n_words"),
)
BIT = {r.name: 1 << r.bit for r in RULES}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that a document must not fail."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))
POLICIES = (BASE, STRICT)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows found twice or more: sort (hash, position), mark equal neighbours, add up what each covers."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        marked = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (x["h"] == pairs[F.greatest(i - 1, F.lit(0))]["h"]))
            | ((i < last) & (x["h"] == pairs[F.least(i + 1, last)]["h"])),
        )
        starts = F.array_sort(F.transform(marked, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(
                (s + WINDOW).alias("end"), (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements and ``failed`` (bit mask of failed rules) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    n = F.size("words")
    window = lambda i: F.xxhash64(*(F.col("words")[i + k] for k in range(WINDOW)))
    rows = rows.withColumn(
        "hashes",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(
            F.array().cast("array<bigint>")
        ),
    ).withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    )
    letters = F.regexp_replace("text", r"\P{L}+", "")
    measured = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("hashes")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_word_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct_words"),
        F.length(letters).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("bigint").alias("n_capitals"),
        count_chars(F.col("text"), "!").cast("bigint").alias("n_exclaims"),
    )
    # Behind the generator a filter on a measurement cannot be pushed down, where it would evaluate them all anew.
    out = rows.select("doc_id", F.explode(F.array(measured)).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return out.withColumn("failed", mask.cast("bigint"))


def apply_policy(led: DataFrame, policy: Policy, to: str = "kept") -> DataFrame:
    return led.withColumn(to, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many it fails, how many it alone drops, how many would be kept without it.

    The ledger shrinks to one row per distinct mask before anything is compared, so the cost is one pass of counts.
    """
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules))
    x = masks.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.*")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return apply_policy(led, STRICT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed"
    )


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_CASES = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS lines
  FROM documents),
w AS (SELECT *, row_number() OVER () AS r FROM d),
g AS (SELECT r, i, hash(array_to_string(words[i:i + 4], chr(0))) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g),
p AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
  (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM k WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_word_lines, len(list_distinct(words)) AS n_distinct_words,
    length(regexp_replace(text, '\\PL+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_capitals,
    length(text) - length(replace(text, '!', '')) AS n_exclaims
  FROM w LEFT JOIN p ON w.r = p.r),
f AS (SELECT *, CAST({_CASES} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE.mask}) <> 0 AS base_failed,
  (failed & {STRICT.mask}) = 0 AS kept, failed FROM f
"""
