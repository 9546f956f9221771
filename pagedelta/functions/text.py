"""Scalar functions on text, urls and times, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode; Java's \s alone is ASCII.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SNIPPET = 2000
LONG_SENTENCE = 200
CHUNK_WORDS = 15


def normalize_text(text: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def word_count(normal: Column) -> Column:
    """Words of a normalised text."""
    return F.when(normal == "", 0).otherwise(F.size(F.split(normal, " ")))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? and white space; long ones in chunks of words; no blank ones."""
    parts = F.split(text, rf"(?<=[.!?]){SPACE}")

    def pieces(p: Column) -> Column:
        tidy = F.trim(F.regexp_replace(p, SPACE, " "))
        chunks = F.regexp_extract_all(tidy, F.lit(rf"(?:[^ ]+ ){{0,{CHUNK_WORDS - 1}}}[^ ]+"), F.lit(0))
        return F.when(F.length(p) > LONG_SENTENCE, chunks).otherwise(F.array(F.regexp_replace(p, f"^{SPACE}|{SPACE}$", "")))

    return F.array_remove(F.flatten(F.transform(parts, pieces)), "")


def change_id(ts: Column, domain: Column, url: Column, suffix: str = "") -> Column:
    """Short id of a change. ``ts``: the run's time as text. Not unique: two types may share it (the key is id and type)."""
    tail = [F.lit(f":{suffix}")] if suffix else []
    return F.concat(F.lit("chg_"), F.substring(F.md5(F.concat_ws(":", ts, domain, F.concat(url, *tail))), 1, 12))


def iso_utc(ts: Column) -> Column:
    """A time as ISO 8601 text in UTC, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def truthy(x: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(x, F.lit("")) != ""


def filled(x: Column) -> Column:
    """Whether a list is neither null nor empty."""
    return F.coalesce(F.size(x), F.lit(0)) > 0


def scheme(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL"))


def netloc(url: Column) -> Column:
    """Host with port, as written."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def bare(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def match_key(url: Column) -> Column:
    """Key under which urls that differ in case or trailing slashes meet."""
    return F.rtrim(F.lower(url), F.lit("/"))


def is_trivial_redirect(url: Column, target: Column) -> Column:
    """Whether a redirect changes nothing but case, trailing slashes or a leading www."""
    plain = lambda u: F.replace(match_key(u), F.lit("://www."), F.lit("://"))
    return (match_key(url) == match_key(target)) | (plain(url) == plain(target))


def week_key(ts: Column) -> Column:
    """The Sunday that begins a time's week."""
    day = F.to_date(ts)
    return F.date_sub(day, F.dayofweek(day) - 1)


def has_any(text: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.contains(text, p))


def register(spark: SparkSession) -> None:
    """SQL names for the functions that plain SQL can call."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION match_key(u STRING) RETURNS STRING RETURN rtrim('/', lower(u))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION week_key(ts TIMESTAMP) RETURNS DATE RETURN date_sub(CAST(ts AS DATE), dayofweek(ts) - 1)"
    )
