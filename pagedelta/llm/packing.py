"""Sequence packing by non-negative least squares over length combinations.

Every document's ids, with an end id, are cut into pieces of ``window`` ids and one shorter rest. Whole pieces are
sequences. The rests' lengths, at most ``window - 1`` values, form a histogram; all combinations of up to three lengths
that fill a window exactly are the columns of a least-squares problem whose solution says how often to repeat each. It
is solved on the driver, from the histogram alone, then rounded within the counts; what remains is packed greedily into
deeper exact combinations, and the last of it is laid end to end and cut at the windows. The tail is cut at powers of two,
so no sequence needs padding.

Which slot a rest gets follows from its length and its rank among the rests of that length: no step gathers the pieces
of one length. Ids are found once and kept in a table in the shared folder.

Defined results: a null or empty text is the end id alone; repeated rows are packed as separate documents; a null id
stays null; only the id and text columns are read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WINDOW = 1024
END_ID = 0
PLANNED = 1 << 60  # sequences of rests are numbered from here, those of whole pieces below
TABLE_PARTS = 2000  # of so many parts the counts, 8 bytes for each length of a part, go to every task as one array
PLACES = "array<struct<at:long,n:long,sequence_id:long,offset:long>>"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """A function from a text to the ids that the tokenizer file gives it, without special tokens added.

    The file's vocabulary is run by the faster of two libraries that implement this kind of tokenizer. Texts that hold
    a special token's string go to the file's own library, which treats it in its own way.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", ())]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: part, piece (unique number), doc_id, start, length, nth (among the part's rests
    of that length), doc_tokens, ids (unsigned 32-bit, little-endian)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        piece, seen, rows, size = part << 36, {}, [], 0
        names = ("part", "piece", "doc_id", "start", "length", "nth", "doc_tokens", "ids")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4") if text else np.array([END_ID], "<u4")
                for start in range(0, len(ids), window):
                    own = ids[start : start + window]
                    n = len(own)
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    rows.append((part, piece, doc_id, start, n, nth, len(ids), own.tobytes()))
                    piece += 1
                    size += n
                if size > 1 << 21:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"part int, piece long, doc_id {kind}, start long, length long, nth long, doc_tokens long, ids binary"
    # A null id must survive pandas, which would turn a column of longs with nulls into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    got = rows.mapInPandas(cut, schema.replace(f"doc_id {kind}", "doc_id string"))
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def combinations_of(hist: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill the window with one to three lengths that occur, as rows of three, 0 for no part."""
    have = np.flatnonzero(hist)
    have = have[have > 0]
    a, b = np.meshgrid(have, have, indexing="ij")
    c = window - a - b
    fit = (a <= b) & ((c == 0) | (c >= b) & (hist[np.clip(c, 0, window)] > 0))
    return np.stack([a[fit], b[fit], c[fit]], 1).astype(np.int64)


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared misfit of each length's use; accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    size = len(hist)
    target = hist.astype(float)
    target[0] = 0
    use = lambda x: np.bincount(combos.ravel(), np.repeat(x, 3), size)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue sets the step
        u = use(v)
        u[0] = 0
        v = u[combos].sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        miss = use(y) - target
        miss[0] = 0
        new = np.maximum(y - miss[combos].sum(1) / (1.05 * top), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Combinations with repeat counts, and the histogram of what they leave."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], most: int) -> None:
        n = min([most, *(left[p] // parts.count(p) for p in set(parts))])
        if n > 0:
            for p in parts:
                left[p] -= n
            out.append((parts, int(n)))

    combos = combinations_of(left, window)
    x = solve(left, combos)
    for k in np.argsort(-x, kind="stable"):
        if (n := int(np.rint(x[k]))) < 1:
            break
        take(tuple(int(p) for p in combos[k] if p), n)
    for first in range(window - 1, 0, -1):  # greedy: the longest rest, then the longest that still fits
        while left[first]:
            parts, gap = [first], window - first
            spare = left.copy()
            spare[first] -= 1
            while gap:
                fits = np.flatnonzero(spare[1 : gap + 1]) + 1
                if not len(fits):
                    break
                parts.append(int(fits[-1]))
                spare[fits[-1]] -= 1
                gap -= int(fits[-1])
            if gap:
                break
            take(tuple(parts), int(left[first]))
    return out, left


class Slots:
    """Where the rest of a given length and rank goes."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        combos, left = plan(hist, window)
        by: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        sequence = PLANNED
        for parts, n in combos:
            at, offsets = 0, {}
            for p in parts:
                offsets.setdefault(p, []).append(at)
                at += p
            for p, o in offsets.items():
                by.setdefault(p, []).append((n * len(o), sequence, len(o), o))
            sequence += n
        self.ends = {p: np.cumsum([u[0] for u in us]) for p, us in by.items()}
        self.units = by
        # The rest of the rests, by length, end to end.
        lengths = np.arange(len(left))
        self.starts = np.cumsum(left * lengths) - left * lengths
        total = int((left * lengths).sum())
        self.cuts_from, cut = total - total % window, total - total % window
        self.cuts = [cut]
        for bit in range(window.bit_length() - 1, -1, -1):
            if (total - self.cuts_from) >> bit & 1:
                cut += 1 << bit
                self.cuts.append(cut)
        self.stream = sequence

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, n, sequence, offset) of each part of the rest."""
        ends = self.ends.get(length)
        if ends is not None and rank < ends[-1]:
            k = int(np.searchsorted(ends, rank, "right"))
            n, sequence, slots, offsets = self.units[length][k]
            q = rank - int(ends[k] - n)
            return [(0, length, sequence + q // slots, offsets[q % slots])]
        at = int(self.starts[length]) + (rank - int(ends[-1] if ends is not None else 0)) * length
        out, done = [], 0
        while done < length:
            pos = at + done
            if pos < self.cuts_from:
                sequence, begin, end = pos // self.window, pos - pos % self.window, pos - pos % self.window + self.window
            else:
                k = int(np.searchsorted(self.cuts, pos, "right"))
                sequence, begin, end = self.cuts_from // self.window + k - 1, self.cuts[k - 1], self.cuts[k]
            n = min(length - done, end - pos)
            out.append((done, n, self.stream + sequence, pos - begin))
            done += n
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece."""
    cut = staged(pieces(docs, tokenizer, window, id_col, text_col), "packing-pieces")
    rests = cut.filter(F.col("length") < window)
    per_part = rests.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    few = per_part.agg(F.count_distinct("part")).first()[0] <= TABLE_PARTS
    counts = (per_part if few else per_part.groupBy("length").agg(F.sum("n").alias("n"))).toPandas()
    hist = np.bincount(counts["length"], counts["n"], window + 1).astype(np.int64)
    slots = Slots(hist, window)

    def places(lengths: pd.Series, ranks: np.ndarray) -> pd.Series:
        names = ("at", "n", "sequence_id", "offset")
        got = [[dict(zip(names, x, strict=True)) for x in slots.of(n, r)] for n, r in zip(lengths.tolist(), ranks.tolist(), strict=True)]
        return pd.Series(got, dtype=object)

    if few:
        parts = np.unique(counts["part"].to_numpy(np.int64))
        n = np.zeros((len(parts), window + 1), np.int64)
        n[np.searchsorted(parts, counts["part"]), counts["length"]] = counts["n"]
        before = np.cumsum(n, axis=0) - n

        @F.pandas_udf(PLACES)
        def place(length: pd.Series, part: pd.Series, nth: pd.Series) -> pd.Series:
            return places(length, before[np.searchsorted(parts, part), length] + nth.to_numpy(np.int64))

        placed = rests.withColumn("p", F.explode(place("length", "part", "nth")))
    else:

        @F.pandas_udf(PLACES)
        def place_ranked(length: pd.Series, rank: pd.Series) -> pd.Series:
            return places(length, rank.to_numpy(np.int64))

        before = F.expr("sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        ranks = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
        placed = rests.join(ranks, ["length", "part"]).withColumn("p", F.explode(place_ranked("length", F.col("before") + F.col("nth"))))
    placed = placed.select(
        "doc_id",
        (F.col("start") + F.col("p.at")).alias("start"),
        F.col("p.n").alias("length"),
        F.expr("substring(ids, cast(4 * p.at + 1 as int), cast(4 * p.n as int))").alias("ids"),
        "doc_tokens",
        "p.sequence_id",
        "p.offset",
    )
    whole = cut.filter(F.col("length") == window).select(
        "doc_id", "start", "length", "ids", "doc_tokens", F.col("piece").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return whole.unionByName(placed)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
