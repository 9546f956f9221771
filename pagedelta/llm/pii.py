"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

Four detectors read the text as it stands; what they find is ``base``. Transducers then rewrite it: look-alike and wide
characters become ASCII, invisible ones go, "[at]", "(dot)" and spelled-out at and dot become signs, and runs of spelled
digits become digits. Each keeps, for every character it writes, the source characters that it came from, and they
compose. The same detectors read the rewritten text, and what they find is mapped back to code points of the source; a
find that touches a base span of its kind adds nothing.

Defined results: a null text has no personal data and stays null when redacted; spans of different kinds may overlap;
repeated rows give repeated results; long texts are read whole, in time linear in their length; extra columns pass
through untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at)  # an "@" never belongs to a local part, so no later match reaches before it
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [
        m.span()
        for m in _IP.finditer(text)
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))
    ]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters of other scripts drawn like Latin ones, and the Latin letters that they are drawn like.
_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαυνι",
        "ABESIJKMHOPCTYXaesijopcyxdqwABEZHIKMNOPTYXoauvi",
        strict=True,
    )
)
# Signs that stand for ASCII ones, and characters without width.
_SIGNS = {"․": ".", "。": ".", "｡": ".", "‧": ".", "·": ".", "﹒": ".", "﹫": "@", "＠": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-"}
_BLANKS = "              　"
_HIDDEN = "­​‌‍⁠﻿"


def _plain(c: str) -> str:
    """What a character becomes: ASCII where it is a disguise, else itself."""
    if c in _ALIKE:
        return _ALIKE[c]
    if c in _SIGNS:
        return _SIGNS[c]
    if c in _BLANKS:
        return " "
    if c in _HIDDEN:
        return ""
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff" or "①" <= c <= "ⓩ":
        folded = unicodedata.normalize("NFKC", c)
        return folded if folded.isascii() else c
    d = unicodedata.decimal(c, None)
    return c if d is None else str(d)


_ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb6\xb8-ɏ—-‟€]")
# The digits from zero, as they are spelled in the languages of the corpus, and other spellings.
_SPELLINGS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_ALSO = {"oh": "0", "zwo": "2", "fuenf": "5", "ein": "1"}
_VALUE = {w: str(i) for words in _SPELLINGS.values() for i, w in enumerate(words.split())} | _ALSO
_UNIT = "|".join(sorted(_VALUE, key=lambda w: (-len(w), w)))
_SPELLED = re.compile(rf"(?i)(?:\+\s*|\bplus[\s,-]+|\b)(?:(?:{_UNIT})\b|[0-9]+)(?:[\s,-]+(?:(?:{_UNIT})\b|[0-9]+))+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_WORD_OR_DIGITS = re.compile(rf"(?i){_UNIT}|[0-9]+")
_POINT = "dot|point|punkt|punto"
_POINTS = frozenset(_POINT.split("|"))
# A part of an address has three digits at most; the bound keeps the search linear.
_SPELLED_IP = re.compile(
    rf"(?i)\b(?:(?:{_UNIT})[\s-]+|[0-9]{{1,3}}\s+){{1,3}}(?:(?:{_POINT})\s+(?:(?:{_UNIT})\b[\s-]*|[0-9]{{1,3}}\s*){{1,3}}){{3}}"
)
# So many spelled digits make a number without a plus sign a disguise rather than prose that counts.
_MIN_SPELLED = 4

_OPEN, _CLOSE = r"[\[({<]\s*", r"\s*[\])}>]"
_AT = rf"\s*{_OPEN}(?:at|@){_CLOSE}\s*|\s+at\s+|\s+@\s*|@\s+|@|[_-]at[_-]"
_DOT = rf"\s*{_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}\s*|\s+dot\s+|\s+\.\s*(?=[a-z])|\.|[_-]dot[_-]"
_SEGMENT = r"[a-z0-9%+]++"
_LOCAL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-]){_SEGMENT}(?:(?:[._%+-]|{_DOT}){_SEGMENT})*+")
_AT_SIGN = re.compile(rf"(?i)(?<=[a-z0-9%+])(?:{_AT})")
# A label ends before a disguised dot, so what follows never has to give any of it back.
_LABEL = r"[a-z0-9]++(?:-(?!dot[_-])[a-z0-9]++)*+"
_HOST = re.compile(rf"(?i)(?P<first>{_LABEL})(?P<rest>(?:(?:{_DOT}){_LABEL})*+)")
_WRITTEN_DOT = re.compile(r"(?i)^(?!(?:the|a|an|this|that)\b).*(?:\bdot\b|[\[({<])", re.S)
_DOT_ONLY = re.compile(rf"(?i){_DOT}")


class Rewritten:
    """A text with, for each of its characters, the start and end in the source of what it came from."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray) -> None:
        self.text, self.start, self.end = text, start, end

    @classmethod
    def of(cls, text: str) -> Rewritten:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.start[start]), int(self.end[end - 1])

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace each (start, end) by a text, all of which comes from all that it replaces."""
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a])]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        texts.append(self.text[done:])
        return Rewritten("".join(texts), np.concatenate([*starts, self.start[done:]]), np.concatenate([*ends, self.end[done:]]))


def _unlike(text: str) -> list[tuple[int, int, str]]:
    got = ((m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text))
    return [x for x in got if x[2] != text[x[0] : x[1]]]


def _undisguise(text: str) -> list[tuple[int, int, str]]:
    """Disguised at and dot signs inside what reads as an address."""
    edits: list[tuple[int, int, str]] = []
    done, local, at = 0, _LOCAL.search(text), _AT_SIGN.search(text)
    while at:
        (a, b), host = at.span(), _HOST.match(text, at.end())
        if not host or not host["rest"]:
            at = _AT_SIGN.search(text, a + 1)
            if at and host and b <= at.start() < host.end():
                at = _AT_SIGN.search(text, host.end())  # a sign inside the label comes to the same end of it, where no dot is
            continue
        while local and local.end() < a:
            local = _LOCAL.search(text, local.end())
        if local and local.start() < done:
            local = _LOCAL.search(text, done)
        if not local or local.start() >= a:
            at = _AT_SIGN.search(text, a + 1)
            continue
        done = host.end()
        plain_at = at[0].strip() == "@" or any(x in at[0] for x in "[({<_-")
        if plain_at or _WRITTEN_DOT.search(host[0]):  # else "look at example.com" is prose
            for lo, hi in ((local.start(), a), host.span()):
                edits += [(x.start() + lo, x.end() + lo, ".") for x in _DOT_ONLY.finditer(text[lo:hi]) if x[0] != "."]
            if at[0] != "@":
                edits.append((a, b, "@"))
        at = _AT_SIGN.search(text, done)
    return sorted(edits)


def _read_digits(part: str) -> str:
    return "".join(_VALUE.get(x.casefold(), x) for x in _WORD_OR_DIGITS.findall(part))


def _may_spell(text: str) -> bool:
    """Whether a spelled digit stands beside another digit; cheap, and true wherever ``_spelled`` finds anything."""
    tokens = _TOKEN.findall(text.casefold())
    last = len(tokens) - 1
    return any(
        any(x in _VALUE or x[0].isdecimal() or x in _POINTS for x in (tokens[max(i - 1, 0)], tokens[min(i + 1, last)]))
        for i, t in enumerate(tokens)
        if t in _VALUE
    )


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    low = text.casefold()
    for m in _SPELLED_IP.finditer(text) if sum(map(low.count, _POINTS)) >= 3 else ():
        new = ".".join(_read_digits(p) for p in re.split(rf"(?i){_POINT}", m[0]))
        edits.append((m.start(), m.start() + len(m[0].rstrip(" \t\r\n-")), new))
    ends = [b for _, b, _ in edits]
    taken = len(edits)
    for m in _SPELLED.finditer(text):
        units = _WORD_OR_DIGITS.findall(m[0])
        spelled = sum(u[0].isalpha() for u in units)
        at = bisect_right(ends, m.start(), hi=taken)
        if not spelled or at < taken and edits[at][0] < m.end():
            continue
        d, signed = _read_digits(m[0]), m[0][:1] in "+pP"
        card = 14 <= len(d) <= 19 and luhn(d)
        if card or signed or spelled >= _MIN_SPELLED:
            edits.append((m.start(), m.end(), d if (card and not signed) or not 10 <= len(d) <= 15 else "+" + d))
    return sorted(edits)


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind as in ``KINDS``."""
    if not text:
        return []
    base = {k: f(text) for k, f in DETECTORS.items()}
    out = [(k, a, b, True) for k, spans in base.items() for a, b in spans]
    now = None
    if not text.isascii() and (edits := _unlike(text)):
        now = Rewritten.of(text).apply(edits)
    low = (now.text if now else text).lower()
    if "at" in low or "@" in low:
        if edits := _undisguise(now.text if now else text):
            now = (now or Rewritten.of(text)).apply(edits)
    if _may_spell(now.text if now else text):
        if edits := _spelled(now.text if now else text):
            now = (now or Rewritten.of(text)).apply(edits)
    if now is not None and now.text != text:
        for k, f in DETECTORS.items():
            plain = np.array(base[k], np.int64).reshape(-1, 2)
            for i, j in f(now.text):
                a, b = now.source(i, j)
                at = np.searchsorted(plain[:, 1], a, "right")
                if at == len(plain) or plain[at, 0] >= b:
                    out.append((k, a, b, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None) -> str | None:
    """The text with every span, or union of overlapping spans, replaced by the kind of its first in brackets."""
    if not text:
        return text
    parts, done = [], 0
    for kind, a, b, _ in find(text):
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]]) if parts else text


def spans(text: Column) -> Column:
    """All spans of a text as an array of structs."""

    @F.pandas_udf(SPAN_TYPE)
    def found(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in find(t)] for t in texts], dtype=object)

    return found(text)


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in texts], dtype=object)

    return clean(text)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", spans(F.col("text")).alias("found"))
    rows = rows.withColumn("plain", F.filter("found", lambda x: x["base"]))
    count = lambda k: F.size(F.filter("plain", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(_joined(F.col("plain")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
