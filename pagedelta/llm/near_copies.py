"""Near copies by exact Jaccard similarity of five-word shingles, joined with what SimHash links.

Two texts are linked when the sets of their shingles have a Jaccard similarity of at least 0.8, or when op8 links them. SimHash
alone does not reach that similarity: fingerprints of pairs at 0.8 to 0.9 differ in up to 17 of 64 bits.

Candidates come from a prefix filter: in whatever order all shingles are put, sets of similarity t share one among the first
n - ceil(t * n) + 1 of each. Common shingles, known from a sample, are put last, so that few sets meet in a common line; the sample
changes the work and not the result. Sets that meet in a shingle are first compared with the least and the greatest of them. What
a pair shares of its prefixes bounds what it can share, and pairs that cannot be similar enough are not compared.

A pair's sets need not be fetched to see that they differ: bit k of a parity signature is the parity of the elements that hash to k,
so the signatures of two sets differ in at most as many bits as the sets differ in elements. What still lies in several components
is searched by signatures alone: sets that meet in a shingle are compared, a block of ``SHARD`` with a block at a time, and only
pairs whose signatures are near enough, and whose components differ, become rows. Every link by similarity is confirmed on the
whole sets.

Defined results: as in ``simhash``; a text of fewer than five words has one shingle, the whole text. Equal texts are one vertex,
named by the XXH64 of the text; where texts with one XXH64 differ in a second hash, by both, so 128 bits tell texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batches_of, checkpointed, let, staged

SHINGLE = 5
# The similarity as a fraction, 4 / 5.
NUM, DEN = 4, 5
SAMPLE = 10_000
MAX_COMMON = 200_000
TABLE_BITS = 1 << 22
SIGNATURE_BITS = 512
WIDE_BITS = 8192
SHARD = 4096
BLOCK = 64
CHUNK = 100_000
#: More names than this that texts share are no chance.
MAX_SHARED = 1000


def _common(docs: DataFrame, text: Column) -> Column | None:
    """A bit table of shingles that texts of a sample share, the most frequent where there are too many."""
    step = max(1, -(-docs.count() // SAMPLE))
    words, hashes = simhash.shingle_hashes(text, SHINGLE)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(step)) == 0).select(words.alias("words"))
    each = some.select(F.explode(F.array_distinct(hashes)).alias("h"))
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(MAX_COMMON)
    at = shared.select("h").toArrow().column("h").to_numpy().astype(np.int64) & (TABLE_BITS - 1)
    if not len(at):
        return None
    bits = np.zeros(TABLE_BITS // 64, np.uint64)
    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return F.split(F.lit(",".join(map(str, bits.view(np.int64)))), ",").cast("array<bigint>")


def _prefix(hashes: Column, common: Column | None) -> Column:
    """n, the number of distinct shingles, and the prefix of their set. The sign of an element puts common shingles last."""

    def placed(h: Column) -> Column:
        slot = h.bitwiseAND(F.lit(TABLE_BITS - 1))
        word = common[F.shiftright(slot, 6).cast("int")]
        bit = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        return F.when(bit == 1, h.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(h.bitwiseOR(F.lit(-(1 << 63))))

    keys = hashes if common is None else F.transform(hashes, placed)

    def of(s: Column) -> Column:
        n = F.size(s)
        # n - ceil(n * NUM / DEN) + 1, in whole numbers
        most = n - F.floor((NUM * n + (DEN - 1)) / DEN).cast("int") + 1
        return F.struct(n.alias("n"), F.slice(s, F.lit(1), most).alias("prefix"))

    return let(F.sort_array(F.array_distinct(keys)), of)


def _alike(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb) of for each shingle of both prefixes, that can be similar enough.

    Past the prefix that ends first a pair shares at most what is left of its set.
    """
    pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count(F.lit(1)).alias("c"))
    rest = F.floor((NUM * F.greatest("na", "nb") + (DEN - 1)) / DEN) - 1
    can = (NUM + DEN) * (F.col("c") + rest) >= NUM * (F.col("na") + F.col("nb"))
    return pairs.filter(can & (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb")))


def _near_enough(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose signatures, of ``marks`` (key, bits), do not rule them out."""
    of = lambda key, to: marks.select(F.col("key").alias(key), F.col("bits").alias(to))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    pairs = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return pairs.filter((NUM + DEN) * apart <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _key(docs: DataFrame, text: Column) -> Column:
    """A 64-bit name of a text. Names that two different texts would share, of which there is hardly ever one, are made anew."""
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    pairs = docs.select(first.alias("first"), second.alias("second")).groupBy("first").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    shared = [r["first"] for r in pairs.filter("lo <> hi").select("first").limit(MAX_SHARED + 1).collect()]
    if len(shared) > MAX_SHARED:
        raise ValueError("so many texts share a hash that the hash must be at fault")
    return F.when(first.isin(shared), F.xxhash64(F.lit(2), first, second)).otherwise(first) if shared else first


def _shingles_of(pairs: DataFrame, docs: DataFrame, text: Column, key: Column) -> tuple[DataFrame, Column]:
    """(key, words) of the texts of the pairs, a row for each copy, and the hashes of their shingles."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    keys = staged(keys, "near-copies-keys")  # at hand with its size before Spark chooses how to join
    words, _ = simhash.shingle_hashes(F.col("text"))
    _, hashes = simhash.shingle_hashes(F.col("text"), SHINGLE)
    rows = docs.select(key.alias("key"), text.alias("text")).join(keys, "key", "left_semi")
    return rows.select("key", words.alias("words")), hashes


def _confirmed(pairs: DataFrame, docs: DataFrame, text: Column, key: Column) -> DataFrame:
    """Those pairs (a, b, na, nb) whose sets are similar enough, after wide signatures have ruled out most of the others."""
    pairs = staged(pairs, "near-copies-pairs")
    rows, hashes = _shingles_of(pairs, docs, text, key)
    with batches_of(docs.sparkSession, simhash.ARROW_ROWS):
        wide = staged(rows.select("key", signatures(hashes, WIDE_BITS).alias("bits")).groupBy("key").agg(F.first("bits").alias("bits")), "near-copies-wide")
    pairs = staged(_near_enough(pairs, wide), "near-copies-pairs")
    rows, hashes = _shingles_of(pairs, docs, text, key)
    sets = staged(rows.select("key", F.array_distinct(hashes).alias("s")).groupBy("key").agg(F.first("s").alias("s")), "near-copies-sets")
    of = lambda key, to: sets.select(F.col("key").alias(key), F.col("s").alias(to))
    both, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").filter((NUM + DEN) * both >= NUM * all_).select("a", "b")


def signatures(hashes: Column, width: int = SIGNATURE_BITS) -> Column:
    """Parity signatures, as longs, of the sets of 64-bit hashes in lists."""

    @F.pandas_udf("array<long>")
    def parity(lists: pd.Series) -> pd.Series:
        out = []
        for s in lists:
            odd = np.bincount(np.unique(s).astype(np.int64) & (width - 1), minlength=width) & 1
            out.append(np.packbits(odd.astype(bool)).view(np.int64))
        return pd.Series(out, dtype=object)

    return parity(hashes)


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a, b, na, nb) of one unit whose sets can be similar enough; a has the larger key."""
    key, n, root = (rows[c].to_numpy(np.int64) for c in ("key", "n", "root"))
    bits = np.stack(rows["bits"].to_list()).astype(np.int64).view(np.uint64)
    member = rows["member"].to_numpy(bool)
    of = np.flatnonzero(member)
    asks = of if member.all() else np.flatnonzero(~member)
    found = [np.zeros((2, 0), np.int64)]
    for k in range(0, len(asks), BLOCK):
        q = asks[k : k + BLOCK]
        size = n[q][:, None] + n[of][None, :]
        can = root[q][:, None] != root[of][None, :]
        can &= DEN * np.minimum(n[q][:, None], n[of][None, :]) >= NUM * np.maximum(n[q][:, None], n[of][None, :])
        x, y = np.nonzero(can)
        # Sets that are similar enough differ in at most the ninth part of their sizes' sum, for 4 / 5.
        near = np.bitwise_count(bits[q[x]] ^ bits[of[y]]).sum(1, dtype=np.int64) * (NUM + DEN) <= (DEN - NUM) * size[x, y]
        found.append(np.stack([q[x[near]], of[y[near]]]))
    a, b = np.concatenate(found, 1)
    a, b = np.where(key[a] > key[b], a, b), np.where(key[a] > key[b], b, a)
    return pd.DataFrame({"a": key[a], "b": key[b], "na": n[a], "nb": n[b]})


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their units to pairs; a task holds the rows of one unit, or ``CHUNK`` of many."""
    held: list[pd.DataFrame] = []

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        edge = np.flatnonzero(np.diff(rows["unit"].to_numpy())) + 1
        cuts = [0, *edge, len(rows)]
        got = [_near(rows.iloc[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i > 1]
        return pd.concat([pd.DataFrame(columns=["a", "b", "na", "nb"], dtype=np.int64), *got]).drop_duplicates()

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            rows = pd.concat(held)
            last = (rows["unit"] == rows["unit"].iloc[-1]).to_numpy()
            held = [rows[last]]
            if not last.all():
                yield work(rows[~last])
    if held:
        yield work(pd.concat(held))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the least id reachable through links)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = _key(docs, text)
    words, fours = simhash.shingle_hashes(text)
    _, fives = simhash.shingle_hashes(text, SHINGLE)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), words.alias("words"))
    # In three passes, of which one needs memory for the sets and the others for lists on their way to Python.
    prefixes = rows.select("key", _prefix(fives, _common(docs, text)).alias("p")).groupBy("key").agg(F.first("p").alias("p"))
    prefixes = staged(prefixes, "near-copies-prefixes")
    with batches_of(docs.sparkSession, simhash.ARROW_ROWS):
        bits = staged(rows.select("key", signatures(fives).alias("bits")).groupBy("key").agg(F.first("bits").alias("bits")), "near-copies-bits")
        rows = staged(rows.select("doc_id", "key", simhash.fingerprint(fours).alias("fp")), "near-copies")

    # What op8 links, as links between keys.
    fps = staged(rows.groupBy("fp").agg(F.min("key").alias("least")), "near-copies-fps")
    a, b = fps.select(F.col("fp").alias("a"), F.col("least").alias("ka")), fps.select(F.col("fp").alias("b"), F.col("least").alias("kb"))
    edges = simhash.links(fps.select("fp")).join(a, "a").join(b, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    edges = edges.unionByName(rows.join(fps, "fp").select(F.col("key").alias("a"), F.col("least").alias("b")))

    # Sets that share a shingle of both prefixes.
    each = prefixes.select("key", "p.n", F.explode("p.prefix").alias("h"))
    me = F.struct("key", "n")
    # Aggregates and a join, which Spark combines early and can split: a shingle may stand in a third of all texts.
    ends_of = each.groupBy("h").agg(F.min(me).alias("lo"), F.max(me).alias("hi")).filter("lo.key < hi.key")
    met = staged(each.join(ends_of, "h"), "near-copies-met")

    def ends(end: str) -> DataFrame:
        a, b = F.greatest(me, F.col(end)), F.least(me, F.col(end))
        pairs = met.select(a.alias("x"), b.alias("y")).filter("x.key <> y.key")
        return pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))

    first = _alike(ends("lo")).unionByName(_alike(ends("hi"))).distinct()
    edges = edges.unionByName(_confirmed(_near_enough(first, bits), docs, text, key)).filter("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    roots = simhash.components(edges)

    # What meets and is not yet connected.
    left = met.join(roots.select(F.col("v").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Shingles that the same sets have are one group, named by sums over its sets; two groups of one name would be searched as one.
    left = staged(left.select("h", "key", "n", "root"), "near-copies-met")
    alike = F.xxhash64(F.sum(F.xxhash64("key") % F.lit(1 << 40)), F.bit_xor(F.xxhash64("key", F.lit(1))), F.count(F.lit(1)))
    groups = left.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), alike.alias("group")).filter("r0 < r1").select("h", "group")
    left = staged(left.join(groups, "h").select("group", "key", "n", "root").distinct(), "near-copies-left")
    units = simhash.units(left.join(bits, "key"), ("key", "n", "root", "bits"), SHARD)
    more = units.repartition("unit").sortWithinPartitions("unit").mapInPandas(_search, "a long, b long, na long, nb long").distinct()
    more = checkpointed(_confirmed(more, docs, text, key))
    if not more.isEmpty():
        roots = simhash.components(edges.unionByName(more).distinct())

    named = rows.select("doc_id", "key").join(roots.withColumnRenamed("v", "key"), "key", "left")
    named = named.select("doc_id", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "component_id")
