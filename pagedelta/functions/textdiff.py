"""Difference of two texts by sentences."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CHUNK_WORDS, LONG_SENTENCE, sentences

SHOWN = 5
SHOWN_CHARS = 150
MIN_CHARS = 10
DIFF = "struct<added:array<string>,removed:array<string>,summary:string>"

_END = re.compile(r"(?<=[.!?])\s+")


def split_sentences(text: str) -> list[str]:
    out = []
    for part in _END.split(text):
        if len(part) > LONG_SENTENCE:
            words = part.split()
            out += [" ".join(words[k : k + CHUNK_WORDS]) for k in range(0, len(words), CHUNK_WORDS)]
        elif part.strip():
            out.append(part.strip())
    return out


def _shown(lines: list[str]) -> list[str]:
    return [x[:SHOWN_CHARS] for x in lines[:SHOWN]]


def text_diff(old: str | None, new: str | None) -> tuple[list[str], list[str], str]:
    """Sentences added, sentences removed, and a phrase that says so.

    With either side empty the other's first sentences are shown as they are; else only lines of over ``MIN_CHARS`` count,
    and lines that read as a diff's own headers do not.
    """
    if not old and not new:
        return [], [], "No content available"
    if not old:
        return _shown(split_sentences(new)), [], f"Content captured ({len(new.split())} words)"
    if not new:
        return [], _shown(split_sentences(old)), "Content removed"
    sides: dict[str, list[str]] = {"+": [], "-": []}
    for line in difflib.unified_diff(split_sentences(old), split_sentences(new), lineterm="", n=0):
        side, rest = line[:1], line[1:].strip()
        if side in sides and line[:3] not in ("+++", "---") and len(rest) > MIN_CHARS:
            sides[side].append(rest)
    added, removed = _shown(sides["+"]), _shown(sides["-"])
    said = [f"{len(x)} section(s) {verb}" for x, verb in ((added, "added"), (removed, "removed")) if x]
    return added, removed, ", ".join(said) or "Minor text changes detected"


def diff_summary(old: Column, new: Column) -> Column:
    """``text_diff`` as a struct column."""
    return F.pandas_udf(_diffs, DIFF)(old, new)


def set_diff(old: Column, new: Column) -> Column:
    """As ``diff_summary``, of built-in expressions: the sentences of over ``MIN_CHARS`` that the other text has nowhere, wherever they stand."""
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  for within a lambda an expression is evaluated at each element

    def lacking(a: Column, b: Column) -> Column:
        lines = F.filter(a, lambda x: ~F.array_contains(b, x) & (F.length(x) > MIN_CHARS))
        return F.transform(F.slice(lines, 1, SHOWN), lambda x: F.substring(x, 1, SHOWN_CHARS))

    def said(lines: Column, verb: str) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.size(lines).cast("string"), F.lit(f" section(s) {verb}")))

    def found(s: Column) -> Column:
        return F.struct(lacking(s["new"], s["old"]).alias("added"), lacking(s["old"], s["new"]).alias("removed"))

    def told(d: Column) -> Column:
        summary = F.concat_ws(", ", said(d["added"], "added"), said(d["removed"], "removed"))
        return F.struct(d["added"].alias("added"), d["removed"].alias("removed"), F.when(summary == "", "Minor text changes detected").otherwise(summary).alias("summary"))

    return once(once(F.struct(sentences(old).alias("old"), sentences(new).alias("new")), found), told)


def _diffs(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    got = [text_diff(a, b) for a, b in zip(old, new, strict=True)]
    return pd.DataFrame(got, columns=["added", "removed", "summary"])
