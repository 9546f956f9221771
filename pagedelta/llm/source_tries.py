"""Audit of how sources of one language differ, by mergeable byte tries.

A partition keeps its terms in a radix trie over UTF-8 bytes for each language; a leaf counts the term's occurrences by
source and its documents. Tries are written down in the order of their bytes, which is that of UTF-8, and dealt out by ranges
of (language, term), so a range has all there is of its prefixes; there the tries are merged, leaf by leaf, and terms of too
few documents are left out. A task counts ``CHUNK_BYTES`` of texts at a time and writes their tries down, so memory is bounded.

A second pass reads the merged terms in order. Of a term that few sources have, only the pairs with one of those are
computed; for all other pairs the term counts as one that neither has, which is added once for all terms. All arithmetic is on
64-bit integers, and exact for up to 9 * 10**15 occurrences in a language.

The driver and every task hold one row for each source; what is returned has a row for each pair of sources of a language.

Defined results: null language, source and text are empty; a source without terms has a row for every other source of its
language and no terms; a source that is alone in its language has no pairs; every row is a document, also where ids or rows
repeat; only the three columns are read, so other names cannot clash; an empty table gives an empty result. Texts are read
whole, in time linear in their length.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

MIN_DOCS = 3
TOP = 200
#: Shares are whole billionths.
ONE = 1_000_000_000
CHUNK_BYTES = 24_000_000
BURST = 2048
#: Rows of partial counts that one range merges, about.
RANGE_ROWS = 400_000
CELLS = 1 << 20
#: Bytes of terms, A-Z in lower case, and blanks for all others: U+0000 to U+0040, U+005B to U+0060 and U+007B to U+007F.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
COUNTS = "lang string, term string, n_docs bigint, sources array<string>, counts array<bigint>"


class _Fork:
    """Terms that begin with ``prefix``: the leaf of the prefix itself, and by the next byte forks or buckets of the longer ones."""

    __slots__ = ("prefix", "children", "leaf")

    def __init__(self, prefix: bytes):
        self.prefix, self.children, self.leaf = prefix, {}, None


class Trie:
    """A radix trie over bytes. A leaf is a list: documents, then source, occurrences, source, occurrences and so on.

    Below the forks lie buckets, dicts from whole terms to leaves; one of more than ``BURST`` terms becomes a fork at the first
    byte in which they differ.
    """

    def __init__(self):
        self.root: _Fork | dict = {}

    def _put(self, parent: _Fork | None, byte: int, node: _Fork) -> _Fork:
        if parent is None:
            self.root = node
        else:
            parent.children[byte] = node
        return node

    def leaf(self, term: bytes) -> list:
        """The leaf of a term, which is added if need be."""
        parent, byte, node = None, 0, self.root
        while type(node) is _Fork:
            prefix = node.prefix
            if not term.startswith(prefix):
                fork = _Fork(commonprefix([term, prefix]))
                fork.children[prefix[len(fork.prefix)]] = node
                node = self._put(parent, byte, fork)
                continue
            if len(term) == len(prefix):
                if node.leaf is None:
                    node.leaf = [0]
                return node.leaf
            parent, byte = node, term[len(prefix)]
            node = parent.children.get(byte)
            if node is None:
                node = parent.children[byte] = {}
        leaf = node.get(term)
        if leaf is None:
            leaf = node[term] = [0]
            if len(node) > BURST:
                fork = self._put(parent, byte, _Fork(commonprefix(list(node))))
                for t, own in node.items():
                    if len(t) == len(fork.prefix):
                        fork.leaf = own
                    else:
                        fork.children.setdefault(t[len(fork.prefix)], {})[t] = own
        return leaf

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Terms and their leaves in the order of their bytes."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is dict:
                for term in sorted(node):
                    yield term, node[term]
                continue
            if node.leaf is not None:
                yield node.prefix, node.leaf
            stack += [node.children[byte] for byte in sorted(node.children, reverse=True)]


def _written(tries: dict[str, Trie], names: list[str], min_docs: int = 0, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """``COUNTS`` of tries by language, whose leaves number the sources as in ``names``; a source that a leaf names twice is added up."""
    known = pa.array(names, pa.string())

    def batch() -> pa.RecordBatch:
        flat = np.array(cells, np.int64).reshape(-1, 2)
        lists = [known.take(pa.array(flat[:, 0])), pa.array(flat[:, 1])]
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()),
                *(pa.ListArray.from_arrays(ends, x) for x in lists),
            ],
            ["lang", "term", "n_docs", "sources", "counts"],
        )

    for lang in sorted(tries):
        terms, docs, sizes, cells = [], [], [], []
        for term, leaf in tries[lang].items():
            if leaf[0] < min_docs:
                continue
            pairs = leaf[1:]
            if len(pairs) > 2 and len(set(pairs[::2])) < len(pairs) // 2:
                sums: dict[int, int] = {}
                for source, n in zip(pairs[::2], pairs[1::2]):
                    sums[source] = sums.get(source, 0) + n
                pairs = [x for pair in sums.items() for x in pair]
            terms.append(term)
            docs.append(leaf[0])
            sizes.append(len(pairs) // 2)
            cells += pairs
            if len(terms) >= rows:
                yield batch()
                terms, docs, sizes, cells = [], [], [], []
        if terms:
            yield batch()


def _tries(langs: np.ndarray, sources: np.ndarray, n_sources: int, texts: list[bytes]) -> dict[int, Trie]:
    """Tries by number of the language, of texts of which only terms and blanks are left."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    tokens = split.flatten().dictionary_encode()
    terms = tokens.dictionary.cast(pa.binary()).to_pylist()
    term = tokens.indices.to_numpy().astype(np.int64)
    if b"" in terms:  # before the first blank and behind the last
        held = term != terms.index(b"")
        doc, term = doc[held], term[held]

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(keys)
        order = np.argsort(distinct)
        return distinct[order], np.bincount(codes, minlength=len(distinct))[order]

    cells, n = counted((langs[doc] * len(terms) + term) * n_sources + sources[doc])
    once = pd.unique(doc * len(terms) + term)
    of, docs = counted(langs[once // len(terms)] * len(terms) + once % len(terms)) if len(terms) else (cells, n)
    ends = (2 * np.searchsorted(cells // n_sources, of, "right")).tolist()
    flat = np.stack([cells % n_sources, n], 1).ravel().tolist()
    out: dict[int, Trie] = defaultdict(Trie)
    start = 0
    for key, in_docs, end in zip(of.tolist(), docs.tolist(), ends):
        lang, at = divmod(key, len(terms))
        leaf = out[lang].leaf(terms[at])
        leaf[0] = in_docs
        leaf += flat[start:end]
        start = end
    return out


def _count(chunk: int) -> Callable:
    """Tries of the texts of a partition, written down after so many bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def written() -> Iterator[pa.RecordBatch]:
            langs, sources = (pd.factorize(np.array([x[i] for x in held], object), sort=True) for i in (0, 1))
            names = sources[1].tolist()
            for lang, trie in _tries(langs[0], sources[0], len(names), [x[2] for x in held]).items():
                yield from _written({langs[1][lang]: trie}, names)

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                held.append((lang, source, text.as_py().translate(TERM_BYTES)))
                size += len(held[-1][2])
                if size >= chunk:
                    yield from written()
                    held, size = [], 0
        if held:
            yield from written()

    return work


def _merge(min_docs: int) -> Callable:
    """One trie for each language of a range, of all that was counted there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = defaultdict(Trie)
        names: list[str] = []
        number: dict[str, int] = {}
        for batch in batches:
            langs, docs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            terms = batch.column(1).cast(pa.binary()).to_pylist()
            ends = batch.column(3).offsets.to_numpy()
            sources = batch.column(3).flatten().dictionary_encode()
            for source in sources.dictionary.to_pylist():
                if source not in number:
                    number[source] = len(names)
                    names.append(source)
            at = np.array([number[x] for x in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()]
            cells = np.stack([at, batch.column(4).flatten().to_numpy()], 1).ravel().tolist()
            ends = (2 * (ends - ends[0])).tolist()
            for i, (lang, term, n) in enumerate(zip(langs, terms, docs)):
                leaf = tries[lang].leaf(term)
                leaf[0] += n
                leaf += cells[ends[i] : ends[i + 1]]
        yield from _written(tries, names, min_docs)

    return work


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), without leaving 64 bits."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def _chi(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Audit:
    """Sums by pair and best terms by source, over the terms of one language that a task reads."""

    def __init__(self, sources: list[str], totals: list[int], vocabulary: int, top: int):
        self.sources, self.at, self.top = sources, {s: i for i, s in enumerate(sources)}, top
        self.totals = np.array(totals, np.int64) + vocabulary
        self.total = sum(totals) + vocabulary
        self.absent = np.array([shares(np.zeros(1, np.int64), int(t))[0] for t in self.totals])
        self.neither = _chi(self.absent[:, None], self.absent[None, :])
        self.sums = np.zeros((len(sources), len(sources)), np.int64)
        self.best: dict[int, list[tuple[int, bytes]]] = defaultdict(list)

    def add(self, terms: pa.Array, sizes: np.ndarray, sources: pa.Array, counts: np.ndarray) -> None:
        names = sources.dictionary_encode()
        column = np.array([self.at[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        row = np.repeat(np.arange(len(sizes)), sizes)
        share = np.empty(len(counts), np.int64)
        for c in np.unique(column):
            share[column == c] = shares(counts[column == c], int(self.totals[c]))
        step = max(1, CELLS // len(self.sources))
        for start in range(0, len(sizes), step):
            a, b = np.searchsorted(row, (start, start + step))
            self._pairs(row[a:b] - start, column[a:b], share[a:b], min(step, len(sizes) - start))
        of_lang = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
        self._terms(terms, row, column, share, shares(of_lang, self.total))

    def _pairs(self, row: np.ndarray, column: np.ndarray, share: np.ndarray, n: int) -> None:
        has = np.zeros((n, len(self.sources)), bool)
        has[row, column] = True
        p = np.tile(self.absent, (n, 1))
        p[row, column] = share
        for c in np.unique(column):
            of = has[:, c]
            mine, theirs, lacks = p[of, c][:, None], p[of], ~has[of]
            square = (mine - theirs) ** 2
            self.sums[c] += (square // theirs).sum(0) - len(mine) * self.neither[c]
            self.sums[:, c] += np.where(lacks, square // mine, 0).sum(0) - lacks.sum(0) * self.neither[:, c]

    def _terms(self, terms: pa.Array, row: np.ndarray, column: np.ndarray, p: np.ndarray, of_lang: np.ndarray) -> None:
        q = of_lang[row]
        more = p > q
        row, column, value = row[more], column[more], _chi(p[more], q[more])
        rank = np.empty(len(terms), np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((rank[row], -value, column))
        first = np.searchsorted(column[order], np.arange(len(self.sources) + 1))
        for c in np.unique(column):
            chosen = order[first[c] : first[c + 1]][: self.top]
            got = zip((-value[chosen]).tolist(), terms.take(pa.array(row[chosen])).to_pylist())
            self.best[c] = sorted([*self.best[c], *got])[: self.top]

    def rows(self, lang: str) -> Iterator[tuple]:
        for i, j in np.argwhere(self.sums).tolist():
            yield lang, self.sources[i], "pair", self.sources[j], int(self.sums[i, j])
        for i, best in self.best.items():
            for value, term in best:
                yield lang, self.sources[i], "term", term.decode(), -value


def _score(languages: dict[str, tuple], top: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[str, _Audit] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                part = batch.filter(pc.equal(langs.indices, k)) if len(langs.dictionary) > 1 else batch
                if lang not in audits:
                    audits[lang] = _Audit(*languages[lang], top)
                sources, counts = part.column(3), part.column(4)
                audits[lang].add(part.column(1).cast(pa.binary()), np.diff(sources.offsets.to_numpy()), sources.flatten(), counts.flatten().to_numpy())
        for lang, audit in audits.items():
            rows = list(audit.rows(lang))
            if rows:
                kinds = [pa.string()] * 4 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["lang", "source", "part", "item", "value"])

    return work


def merged_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``COUNTS`` of every term in at least so many documents of its language, one row for a term, ranges in order."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = staged(rows.mapInArrow(_count(CHUNK_BYTES), COUNTS), "term-tries")
    ranges = max(spark.sparkContext.defaultParallelism, -(-counted.count() // RANGE_ROWS))
    return staged(counted.repartitionByRange(ranges, "lang", "term").mapInArrow(_merge(min_docs), COUNTS), "term-counts")


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from the others of its language, and the terms it has most above it."""
    terms = merged_counts(docs, lang_col, source_col, text_col, min_docs)
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source")))).distinct()
    sums = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source"))
    groups = groups.join(sums.agg(F.sum("x.counts").alias("n")), ["lang", "source"], "left").join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left")
    groups = staged(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "term-sources")
    languages = {}
    for r in groups.filter("v > 0").sort("lang", "source").collect():
        names, totals, _ = languages.setdefault(r.lang, ([], [], r.v))
        names.append(r.source)
        totals.append(r.n)
    scores = staged(terms.mapInArrow(_score(languages, top), "lang string, source string, part string, item string, value bigint"), "term-scores")

    absent = F.expr(f"CASE WHEN v > 0 THEN 1 + {ONE} div (n + v) ELSE 1 END")
    mine = groups.select("lang", "source", "v", absent.alias("p"))
    theirs = groups.select("lang", F.col("source").alias("item"), absent.alias("q"))
    found = scores.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = mine.join(theirs, "lang").filter("source <> item").join(found, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("v * ((p - q) * (p - q) div q) + coalesce(value, 0)").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = scores.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(v.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)
  LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + ({ONE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS HUGEINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, CAST(1 + ({ONE}::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(t.v)) AS HUGEINT) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total, any_value(v) AS v FROM g GROUP BY lang) t USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - l.q) * (p.p - l.q) // l.q AS BIGINT) AS value
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
u AS (SELECT * FROM pr UNION ALL SELECT * FROM tm)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= {TOP}
"""
