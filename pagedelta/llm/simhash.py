"""Near-duplicates by SimHash, linked through BK-trees.

Fingerprints: 64 bits, each the majority over the text's shingle hashes. Texts whose fingerprints differ in at most
``RADIUS`` bits are linked; a component is what links connect.

Equal fingerprints are merged first, so copies cost one row. The 64 bits are cut into runs, ``radius`` + e of them; a pair within
the radius agrees on at least e runs, so it meets in the shard of some e runs' bits. Each shard is a BK-tree: the children of
a node are keyed by their distance to it, and a search for radius r at distance d from a node follows the edges from
d - r to d + r only. e grows with the number of fingerprints, so that a tree has about ``TREE`` nodes; it changes the work and not
the result. Trees of many shards are built and searched together, level by level, in arrays. A shard above ``SHARD`` members is
cut, and every pair of its parts is a unit of work of its own, so that no task holds a group of unbounded size; nothing is left
out. Trees reach their queries through a shuffle: a broadcast of all trees would collect every fingerprint in the driver. A unit
returns a star per local component, not its pairs. Components come from hooking each vertex to its least neighbour, contracting,
and repeating until no link is left.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; rows of equal text are
one component; a component whose ids are all null has a null id; repeated rows are returned as often as they occur; only
the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, staged, table, words_of

SHINGLE = 4
RADIUS = 4
TREE = 512
MOST_RUNS = 3
SHARD = 4096
CHUNK = 200_000
ARROW_ROWS = 500
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: Column, size: int = SHINGLE) -> tuple[Column, Column]:
    """The words column, and, over a column named ``words``, the hashes of its shingles."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    w, n = F.col("words"), F.size("words")
    hashes = (
        F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(F.concat_ws(" ", *(w[i + k] for k in range(size))))))
        .when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return words_of(low), hashes


def majority(lists: list[np.ndarray]) -> np.ndarray:
    """For each list of 64-bit hashes the word of the bits set in over half of them; zero for an empty list.

    Eight counters of eight bits are added at once in a 64-bit word, over runs of at most 255 hashes.
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.int64)
    sizes = sizes[full]
    h = np.concatenate([lists[i] for i in full]).astype(np.int64, copy=False).view(np.uint64)
    runs = -(-sizes // 255)
    first_run = np.cumsum(runs) - runs
    doc_start = np.cumsum(sizes) - sizes
    run_start = np.repeat(doc_start, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & LANES, run_start)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        bits = (2 * counts > sizes[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(bits).view(np.uint64).ravel() << np.uint64(shift)
    return out.view(np.int64)


def fingerprint(hashes: Column) -> Column:
    """The fingerprint (64 bits as a signed long) of a column of shingle hashes."""

    @F.pandas_udf("long")
    def simhash(lists: pd.Series) -> pd.Series:
        out, part, size = [], [], 0
        for x in lists:
            part.append(x)
            size += len(x)
            if size > 1_000_000:
                out.append(majority(part))
                part, size = [], 0
        return pd.Series(np.concatenate([*out, majority(part)]) if len(lists) else np.zeros(0, np.int64))

    return simhash(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long)."""
    words, hashes = shingle_hashes(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    return rows.select("doc_id", fingerprint(hashes).alias("fp"))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``label`` maps each element to the least of its set."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Forest:
    """BK-trees, one for each value of ``tree``; ``fp`` are distinct within a tree."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray) -> None:
        self.fp = fp
        self.trees, self.roots = np.unique(tree, return_index=True)
        place = np.searchsorted(self.trees, tree)
        rest = np.flatnonzero(np.arange(len(fp)) != self.roots[place])
        at = self.roots[place][rest]
        keys, kids = [], []
        while len(rest):
            edge = at * 65 + np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
            key, first, which = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            kids.append(rest[first])
            left = np.ones(len(rest), bool)
            left[first] = False
            at, rest = rest[first][which][left], rest[left]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.kids = self.keys[order], self.kids[order]
        self.visited = 0

    def near(self, tree: np.ndarray, fp: np.ndarray, radius: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, a block of queries at a time."""
        place = np.searchsorted(self.trees, tree)
        known = (place < len(self.trees)) & (self.trees[np.minimum(place, len(self.trees) - 1)] == tree)
        asked = np.flatnonzero(known)
        for k in range(0, len(asked), block):
            q = asked[k : k + block]
            at = self.roots[place[q]]
            while len(q):
                self.visited += len(q)
                d = np.bitwise_count(fp[q] ^ self.fp[at]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], at[hit]
                lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right") - lo
                q = np.repeat(q, n)
                at = self.kids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _stars(unit: np.ndarray, fp: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole units of work, as (fp, least fp of its local component)."""
    order = np.lexsort((fp.view(np.int64), unit))
    unit, fp, member = unit[order], fp[order], member[order]
    in_tree = np.flatnonzero(member)
    label = np.arange(len(fp))
    if len(in_tree):
        forest = Forest(unit[in_tree], fp[in_tree])
        for q, node in forest.near(unit, fp, radius):
            merge(label, q, in_tree[node])
    own = fp.view(np.int64)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return own[moved], own[label[moved]]


def runs(n: int, radius: int, tree: int = TREE) -> tuple[list[int], int]:
    """The widths of the runs that 64 bits are cut into, and how many of them a pair within the radius is sure to have alike."""
    for equal in range(1, MOST_RUNS + 1):
        blocks = radius + equal
        width = sorted(64 // blocks + (i < 64 % blocks) for i in range(blocks))
        if n >> sum(width[:equal]) <= tree:
            break
    return width, equal


def units(rows: DataFrame, of: tuple[str, ...], shard: int) -> DataFrame:
    """(unit, *of, member): the work of comparing the rows of each ``group`` with one another.

    A group of one row has none. A group of more than ``shard`` rows is cut by a hash of its first column in ``of``. A unit is a pair of shards, of which the
    second has the members and the first, unless it is the same, is compared with them.
    """
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = rows.join(sizes, "group")
    shards = F.ceil(F.col("_n") / shard).cast("int")
    rows = rows.withColumns({"_shards": shards, "_mine": F.pmod(F.xxhash64(of[0]), shards).cast("int")})
    mine, none = F.col("_mine"), F.array().cast("array<struct<i:int,j:int,member:boolean>>")
    pair = lambda i, j, member: F.struct(i.alias("i"), j.alias("j"), F.lit(member).alias("member"))
    as_member = F.transform(F.sequence(F.lit(0), mine), lambda i: pair(i, mine, True))
    as_query = F.when(mine + 1 < F.col("_shards"), F.transform(F.sequence(mine + 1, F.col("_shards") - 1), lambda j: pair(mine, j, False))).otherwise(none)
    rows = rows.select("group", *of, F.explode(F.concat(as_member, as_query)).alias("_u"))
    return rows.select(F.xxhash64("group", "_u.i", "_u.j").alias("unit"), *of, "_u.member")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints ``fp``, enough of them to connect each component."""
    width, equal = runs(fps.count(), radius)
    low = [sum(width[:i]) for i in range(len(width))]
    run = [F.shiftrightunsigned("fp", low[i]).bitwiseAND(F.lit((1 << width[i]) - 1)) for i in range(len(width))]
    keys = []
    for k, chosen in enumerate(combinations(range(len(width)), equal)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width[i]).bitwiseOR(run[i])
        keys.append(key)
    rows = units(fps.select("fp", F.explode(F.array(*keys)).alias("group")), ("fp",), shard)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            a, b = _stars(rows["unit"].to_numpy(), rows["fp"].to_numpy(np.int64).view(np.uint64), rows["member"].to_numpy(bool), radius)
            got = pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})
            return got.drop_duplicates()

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= CHUNK:
                rows = pd.concat(held)
                last = (rows["unit"] == rows["unit"].iloc[-1]).to_numpy()
                held, size = [rows[last]], int(last.sum())
                if not last.all():
                    yield work(rows[~last])
        if size:
            yield work(pd.concat(held))

    return rows.repartition("unit").sortWithinPartitions("unit").mapInPandas(search, "a long, b long").distinct()


def _resolved(parents: DataFrame) -> DataFrame:
    """(v, root) of a forest (v, p) in which each v has one parent, by pointer jumping."""
    roots = parents.select("v", F.col("p").alias("root"))
    while True:
        roots = checkpointed(roots)
        up = roots.select(F.col("v").alias("root"), F.col("root").alias("next"))
        stepped = roots.join(up, "root", "left")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return roots
        roots = stepped.select("v", F.coalesce("next", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex that is not the least of its component, each once. Edges (a, b) have a > b.

    A vertex that hooks is replaced by the root of its tree of this round in every edge, so it takes part in no later round.
    """
    edges = checkpointed(edges)
    parents = edges.limit(0).select(F.col("a").alias("v"), F.col("b").alias("p"))
    while not edges.isEmpty():
        up = _resolved(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")))
        parents = parents.unionByName(up.withColumnRenamed("root", "p"))
        moved = edges.join(up.select(F.col("v").alias("a"), F.col("root").alias("x")), "a")
        moved = moved.join(up.select(F.col("v").alias("b"), F.col("root").alias("y")), "b", "left")
        x, y = F.col("x"), F.coalesce("y", "b")
        edges = checkpointed(moved.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct())
    return _resolved(parents)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the least id reachable through links)."""
    with batches_of(docs.sparkSession, ARROW_ROWS):
        rows = staged(fingerprints(docs, id_col, text_col), "simhash")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), radius))
    # Only linked fingerprints need a component of their own.
    linked = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    linked = checkpointed(linked.join(fps, linked.v == fps.fp).select("v", "root", "least"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select(F.col("v").alias("fp"), "component_id")
    named = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(staged(named, "simhash-components"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
