"""Periodic runs of words, found by block matching.

A run is a stretch of words that repeats with a smallest period ``q``, is at least ``max(LEAST, TIMES * q)`` words long and
goes on in neither direction. For each power of two ``B`` the aligned blocks of ``B`` words are the patterns of an
Aho-Corasick automaton over word numbers, and the text is searched for them. A run with ``B <= q < 2B`` holds an aligned block
and its copy ``q`` words on, so every occurrence of a block ``B`` to ``2B - 1`` words behind it is a seed; extending the two
copies word by word in both directions gives the longest stretch with that period, exactly.

A key is a short sequence of numbers that each name an equal part of the block exactly; so automata are small, and periodic
texts, whose borders make long chains of failure links, are searched as fast as others.

Only stretches in which every word was met less than ``2B`` words before can be in a run of that scale; the others are not
searched. Seeds inside a run of a smaller scale only find its period, or a multiple, again and are left out. Three or more
copies of one block in reach make the block itself periodic; then two of the distances alone can be the period of a run,
those at which the ends of the periodic stretches around the block and around its copies agree.

Rows are judged one by one and nothing is shuffled. Time is near linear in a text's words and memory linear; scales are
searched in pieces of ``PIECE`` words, or of eight blocks where those are longer.

Defined results: a null or empty text has no words and no runs; repeated rows give the same row each; a null id stays null; only
the id and text columns are read, so other names cannot clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words_of

LEAST = 6
TIMES = 4
PIECE = 1 << 18
LETTERS = 8
CHUNK_BYTES = 4_000_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_FAR = np.iinfo(np.int64).max


def _ahead(w: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, ``b`` staying below ``end``."""
    n, step = 0, 64
    while b + n < end:
        m = min(step, end - b - n)
        differs = w[a + n : a + n + m] != w[b + n : b + n + m]
        if differs.any():
            return n + int(differs.argmax())
        n, step = n + m, min(2 * step, 1 << 16)
    return n


def _behind(w: np.ndarray, a: int, b: int, start: int) -> int:
    """How many words before ``a`` equal those before ``b``, ``a`` staying at ``start`` or above."""
    n, step = 0, 64
    while a - n > start:
        m = min(step, a - n - start)
        differs = w[a - n - m : a - n][::-1] != w[b - n - m : b - n][::-1]
        if differs.any():
            return n + int(differs.argmax())
        n, step = n + m, min(2 * step, 1 << 16)
    return n


def _last_met(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words before each word the same word was met in its text, whose start ``first`` gives."""
    out = np.full(len(codes), _FAR)
    order = np.argsort(codes, kind="stable")
    here, before = order[1:], order[:-1]
    same = (codes[here] == codes[before]) & (before >= first[here])
    out[here[same]] = here[same] - before[same]
    return out


def _names(w: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of ``size`` words, a power of two: equal where the stretches are equal, and only there."""
    names, n = pd.factorize(w)[0], 1
    while n < size:
        names = pd.factorize(names[:-n] * len(w) + names[n:])[0]
        n *= 2
    return names


def _seeds(w: np.ndarray, start: int, end: int, block: int, origin: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks of ``w[start:end]`` and the distances, ``block`` to ``2 * block - 1``, at which they recur.

    A block is a key of at most ``LETTERS`` numbers, each of which names as many words as the others. The text is searched in
    every phase of that many words, the phases one behind the other.
    """
    begin = start + (origin - start) % block
    starts = np.arange(begin, end - block + 1, block)
    if not len(starts):
        return starts, starts
    size = max(1, block // LETTERS)
    names = _names(w[start:end], size)
    automaton, ids, name = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, np.empty(len(starts), np.int64)
    keys = names[(starts - start)[:, None] + np.arange(0, block, size)]
    for k, key in enumerate(map(tuple, keys.tolist())):
        name[k] = ids.setdefault(key, len(ids))
        automaton.add_word(key, int(name[k]))
    automaton.make_automaton()
    rows = -(-len(names) // size) + 1
    phases = np.full(rows * size, len(w), np.int64)
    phases[: len(names)] = names
    met = np.array(list(automaton.iter(tuple(phases.reshape(rows, size).T.ravel().tolist()))), np.int64).reshape(-1, 2)
    at = start + met[:, 0] % rows * size + met[:, 0] // rows - (block - size)
    k = (at - block - begin) // block
    held = at - block >= begin
    at, k, found = at[held], k[held], met[held, 1]
    held = name[k] == found
    at, j = at[held], starts[k[held]]
    order = np.lexsort((at, j))
    return j[order], (at - j)[order]


def _open(start: int, end: int, block: int, origin: int, reach: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a region around the aligned blocks that have copies in reach beyond the run they lie in."""
    starts = np.arange(start + (origin - start) % block, end - block + 1, block)
    ahead = np.zeros(len(starts) + 2, np.int8)
    ahead[1:-1] = reach[starts] < starts + 3 * block - 1
    edges = np.flatnonzero(np.diff(ahead))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield int(starts[a]), min(end, int(starts[b - 1]) + 3 * block)


def _pieces(start: int, end: int, block: int) -> Iterator[tuple[int, int]]:
    size = max(PIECE, 8 * block)
    for at in range(start, end, size):
        yield at, min(end, at + size + 4 * block)


def _likely(w: np.ndarray, j: int, distances: list[int], block: int, lo: int, hi: int) -> list[int]:
    """Of three or more distances of one block, those that a run can have as its period."""
    p = distances[1] - distances[0]
    x = j + distances[0]
    end1, end2 = (i + block + _ahead(w, i + block - p, i + block, hi) for i in (j, x))
    start1, start2 = (i - _behind(w, i, i + p, lo) for i in (j, x))
    return [d for d in {end2 - end1, start2 - start1} if d in distances]


def _scale(w: np.ndarray, regions: Iterable[tuple[int, int]], block: int, lo: int, hi: int, reach: np.ndarray, found: dict) -> None:
    """Add to ``found``, (start, end) to period, the runs of one text, ``w[lo:hi]``, with a period of ``block`` to ``2 * block - 1``."""
    fresh, stretches = [], {}
    for region in regions:
        for start, end in [x for part in _open(*region, block, lo, reach) for x in _pieces(*part, block)]:
            j, d = _seeds(w, start, end, block, lo)
            new = reach[j] < j + d + block
            by_block = defaultdict(list)
            for a, b in zip(j[new].tolist(), d[new].tolist()):
                by_block[a].append(b)
            for a, distances in by_block.items():
                for b in distances if len(distances) < 3 else _likely(w, a, distances, block, lo, hi):
                    s, e = stretches.get(b, (0, 0))
                    if s <= a and a + b + block <= e:
                        continue
                    s = a - _behind(w, a, a + b, lo)
                    e = a + b + block + _ahead(w, a + block, a + b + block, hi)
                    stretches[b] = s, e
                    if e - s >= max(LEAST, TIMES * b) and (s, e) not in found:
                        found[s, e] = b
                        fresh.append((s, e))
    for s, e in fresh:
        np.maximum(reach[s:e], e, out=reach[s:e])


def find(codes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period of each text; text ``i`` is ``codes[bounds[i]:bounds[i + 1]]``."""
    sizes = np.diff(bounds)
    first = np.repeat(bounds[:-1], sizes)
    met = _last_met(codes, first)
    reach = np.zeros(len(codes), np.int64)
    found: dict[int, dict] = defaultdict(dict)
    block = 1
    while TIMES * block <= max(sizes, default=0):
        near = np.zeros(len(codes) + 2, np.int8)
        near[1:-1] = met < 2 * block
        edges = np.flatnonzero(np.diff(near))
        start, end = edges[::2], edges[1::2]
        wide = end - start >= max(LEAST - 1, (TIMES - 1) * block)
        regions = defaultdict(list)
        for s, e in zip(start[wide].tolist(), end[wide].tolist()):
            text = int(np.searchsorted(bounds, s, side="right")) - 1
            regions[text].append((max(int(bounds[text]), s - 2 * block + 1), e))
        for text, parts in regions.items():
            _scale(codes, parts, block, int(bounds[text]), int(bounds[text + 1]), reach, found[text])
        block *= 2
    return [sorted((s - int(lo), e - s, q) for (s, e), q in found[i].items()) if i in found else [] for i, lo in enumerate(bounds[:-1])]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts as bytes, few enough at a time that their words fit in memory."""
    held, size = [], 0
    for t in texts.cast(pa.binary()):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in _chunks(batch.column(1)):
            words = [t.split() for t in texts]  # of bytes: at U+0020 and U+0009 to U+000D
            bounds = np.r_[0, np.cumsum([len(x) for x in words])].astype(np.int64)
            flat = np.empty(int(bounds[-1]), object)
            flat[:] = [x for t in words for x in t]
            runs = find(pd.factorize(flat)[0], bounds)
            ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            cells = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(cells[:, i]) for i in range(3)], ["start", "length", "period"])
            out = [
                batch.column(0).slice(at, len(texts)),
                pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(pa.array(ends), items),
                pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])
            at += len(texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the words left when only a run's first period is kept, joined by spaces."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_search, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text, with the tail of every tenth document repeating itself as the contract of the query says."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(words[a + F.pmod(i - a, p)])), " ")

    planted = let(words_of(text), lambda words: F.when(F.size(words) > 0, repeated(words)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = periodic_runs(docs).withColumn("best", longest)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
