"""Removal of repeated byte strings by prefix doubling.

Positions are ranked by the string that begins there, at growing lengths: the rank of a string of 2n bytes is the pair of the
ranks of its halves. Up to ``HALF`` bytes ranks are names, hashes of pairs of names, that need no other position to be
known; there the corpus is sorted for the first time. What is unique drops out. The rest take the pair of names at their
place and ``HALF`` bytes on, are sorted again, and each string of ``LENGTH`` bytes that a smaller document also has is removed
from the larger.

Not every position needs to be sorted. Of the ``HALF``-byte names inside a string of ``LENGTH`` bytes the least one stands for it,
its key, which is the same wherever the string occurs. Strings side by side with one key are a run, cut after ``RUN`` strings, so
that its first and last string hold every byte of it.

1. Keys are sorted: runs whose key is in one document only are done.
2. Of the rest, signatures of whole runs are sorted, by key: a run that a smaller document has from end to end is removed, and
   where all runs of a key are alike nothing else can match.
3. Where runs of a key differ, the smallest document of each signature sends the names of the run's single strings.

Names are sorted in buckets of their hash; a task first merges the equal names of a batch of documents, so a string that all
documents share costs one row a batch. Sorted buckets answer each batch with bits for the names it sent; answers lie in
the shared folder, by batch.

What is removed is decided on 128 bits: a name of the ranks and a check of the bytes themselves, computed apart from each other.
For n candidate strings the chance that any two different ones agree in both is below n * n / 2**129. Keys have 64 bits, for they
only choose what is sorted next.

``suffix_ranks`` is the plain form of the method, all positions as rows, against which this one is tested; the README says why this
one is registered.

Defined results: a null or empty text has no bytes; texts shorter than ``LENGTH`` lose nothing; of documents with equal
texts all but the one with the smallest id lose everything; documents of equal id (repeated rows) never take bytes
from each other; a document without an id neither loses nor takes; only the id and text columns are read; an empty
table gives an empty result. A task holds about sixty bytes for each byte of a batch, or of the longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, staged, table
from .warc import open_fs

HALF = 25
LENGTH = 2 * HALF
RUN = LENGTH - HALF + 1  # strings of a longer run could differ between the bytes of its first and its last
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20
PIECE = 1 << 14
NO_ID = np.iinfo(np.int64).max
U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    x = a * _A
    x += b * _B
    x ^= x >> U(31)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    return x


@cache
def _letters() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], U)


def names(data: np.ndarray) -> np.ndarray:
    """The name of the ``HALF`` bytes at each position, a piece at a time that stays in a core's cache."""
    letters = _letters()
    out = np.empty(max(len(data) - HALF + 1, 0), U)
    for k in range(0, len(out), PIECE):
        x, n = letters[data[k : k + PIECE + HALF - 1]], 1
        while n < HALF:
            step = min(n, HALF - n)
            x = pair(x[:-step], x[step:])
            n += step
        out[k : k + PIECE] = x
    return out


def checks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second name of the ``LENGTH`` bytes at each of ``at``, straight from the bytes."""
    words = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    x = np.zeros(len(at), U)
    for step in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        x ^= words[at + step]
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
    return x


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    out = np.empty(max(len(x) - n + 1, 0), x.dtype)
    for k in range(0, len(out), PIECE):
        y, size = x[k : k + PIECE + n - 1], 1
        while size < n:
            step = min(size, n - size)
            y = np.minimum(y[:-step], y[step:])
            size += step
        out[k : k + PIECE] = y
    return out


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from ``first`` to ``last``, range after range."""
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Batch:
    """Documents laid end to end: ``at[i]`` is where document i begins, ``ids[i]`` its id.

    Run k holds the strings that begin at ``first[k]`` to ``last[k]``, all in document ``doc[k]``; ``low[k]`` is their key.
    """

    def __init__(self, row: pd.Series) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.data = np.frombuffer(row["data"], np.uint8)
        self.long = (np.diff(self.at) >= LENGTH) & (self.ids != NO_ID)
        self.half = names(self.data)
        low = least(self.half, LENGTH - HALF + 1)
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        for i in range(len(self.ids)):  # no string leaves its document
            lo, hi = self.at[i], self.at[i + 1]
            if self.long[i]:
                new[lo] = True
                new[hi - LENGTH + 1 : hi] = False
            else:
                new[lo:hi] = False
        first = np.flatnonzero(new)
        doc = np.searchsorted(self.at, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(low))[: len(first)] - 1, self.at[doc + 1] - LENGTH)
        cuts = (last - first) // RUN + 1
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        self.first = np.repeat(first, cuts) + nth * RUN
        self.last = np.minimum(self.first + RUN - 1, np.repeat(last, cuts))
        self.doc = np.repeat(doc, cuts)
        self.low = low[self.first]

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of the strings that begin at ``at``."""
        return pair(self.half[at], self.half[at + HALF]), checks(self.data, at)

    def signatures(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of whole runs: of a run's first and last string, and its length."""
        a, b = self.first[runs], self.last[runs]
        size = (b - a).astype(U)
        (x, p), (y, q) = self.strings(a), self.strings(b)
        return pair(pair(x, y), size), pair(pair(p, q), ~size)

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A name and a check of the whole text of each long document, and its place."""
        docs = np.flatnonzero(self.long)
        view = memoryview(self.data)
        got = b"".join(hashlib.blake2b(view[self.at[i] : self.at[i + 1]], digest_size=16).digest() for i in docs)
        both = np.frombuffer(got, U).reshape(-1, 2)
        return both[:, 0], both[:, 1], docs


class Merged:
    """The distinct names of a batch, by bucket of their key, each with the smallest id that has it."""

    def __init__(self, name: np.ndarray, check: np.ndarray, ids: np.ndarray, buckets: int, key: np.ndarray | None = None) -> None:
        order, at, _ = _grouped(name, check)
        name, check, ids = name[order], check[order], ids[order]
        self.name, self.check = name[at], check[at]
        self.least = np.minimum.reduceat(ids, at) if len(at) else ids
        self.many = self.least != (np.maximum.reduceat(ids, at) if len(at) else ids)
        self.key = self.name if key is None else key[order][at]
        bucket = (self.key % U(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[self.order])) + 1
        self.parts = [(int(bucket[p[0]]), p) for p in np.split(self.order, cuts)] if len(at) else []

    def rows(self, batch: int, keyed: bool = False) -> pd.DataFrame:
        out = []
        for bucket, part in self.parts:
            known, which = np.unique(self.least[part], return_inverse=True)
            small = which.astype("<u2" if len(known) < 1 << 16 else "<u4")
            key = self.key[part].tobytes() if keyed else b""
            out.append((bucket, batch, self.name[part].tobytes(), self.check[part].tobytes(), key, known.tobytes(), small.tobytes(), np.packbits(self.many[part]).tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    def answers(self, replies: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Both bits of the reply for each of ``name``."""
        out = np.zeros((2, len(self.name)), bool)
        for bucket, part in self.parts:
            for k in (0, 1):
                out[k, part] = np.unpackbits(np.frombuffer(replies[bucket][k], np.uint8), count=len(part))
        return out[0], out[1]

    def find(self, name: np.ndarray, check: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.name, name)
        while (off := self.check[at] != check).any():  # names that agree in two different checks
            at[off] += 1
        return at


SENT = "bucket long, batch long, name binary, check binary, key binary, known binary, which binary, many binary"
REPLY = "part long, batch long, bucket long, earlier binary, shared binary"


def _grouped(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal (name, check) are side by side, by name; where each group begins in it, and the group of each place."""
    order = np.argsort(name)
    x = name[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    y = check[order]
    if (~first[1:] & (y[1:] != y[:-1])).any():  # names that agree in two different checks
        order = np.lexsort((check, name))
        x, y = name[order], check[order]
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def _sorted_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Sort a bucket's names. ``earlier``: a smaller id has the name. ``shared``: another document has it, or, of names with
    keys, the key has other names."""
    names_ = [np.frombuffer(x, U) for x in rows["name"]]
    sizes = np.array([len(x) for x in names_])
    ids = []
    for known, which, n in zip(rows["known"], rows["which"], sizes, strict=True):
        ids.append(np.frombuffer(known, np.int64)[np.frombuffer(which, "<u2" if len(which) == 2 * n else "<u4")])
    name, ids, key = np.concatenate(names_), np.concatenate(ids), np.frombuffer(b"".join(rows["key"]), U)
    check = np.frombuffer(b"".join(rows["check"]), U)
    earlier, shared = np.zeros(len(name), bool), np.zeros(len(name), bool)
    order, at, group = _grouped(name, check)
    own = ids[order]
    smallest = np.minimum.reduceat(own, at) if len(at) else own
    earlier[order] = smallest[group] < own
    if len(key):
        # A key has other names where groups of several numbers have it.
        by_key, begins, of = _grouped(key, np.zeros(len(key), U))
        number = np.empty(len(name), np.int64)
        number[order] = group
        number = number[by_key]
        shared[by_key] = (np.minimum.reduceat(number, begins) != np.maximum.reduceat(number, begins))[of]
    else:
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(rows["many"], sizes, strict=True)])[order]
        if len(at):
            shared[order] = ((smallest != np.maximum.reduceat(own, at)) | (np.maximum.reduceat(many, at) > 0))[group]
    cuts = np.cumsum(sizes)[:-1]
    out = [
        (b >> 24, b, k, np.packbits(e).tobytes(), np.packbits(s).tobytes())
        for b, k, e, s in zip(rows["batch"], rows["bucket"], np.split(earlier, cuts), np.split(shared, cuts), strict=True)
    ]
    return pd.DataFrame(out, columns=["part", "batch", "bucket", "earlier", "shared"])


class _Replies:
    """Answers to the batches of one part, read once."""

    def __init__(self, root: str) -> None:
        self.root, self.part, self.held = root, None, {}

    def of(self, batch: int) -> dict[int, tuple[bytes, bytes]]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        if self.part != batch >> 24:
            self.part, self.held = batch >> 24, {}
            fs, top = open_fs(self.root)
            for f in fs.get_file_info(FileSelector(f"{top}/part={self.part}", allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    t = pq.ParquetFile(fs.open_input_file(f.path)).read()
                    for b, k, e, s in zip(*(t[c].to_pylist() for c in ("batch", "bucket", "earlier", "shared")), strict=True):
                        self.held.setdefault(b, {})[k] = (e, s)
        return self.held.get(batch, {})


class _Rounds:
    """What the rounds have said of one batch so far; each method needs the answers of the rounds before."""

    def __init__(self, batch: Batch, buckets: int) -> None:
        self.batch, self.buckets = batch, buckets
        *self.digest, self.whole = batch.digests()
        self.low = batch.low, np.zeros(len(batch.low), U)
        name, check = (np.concatenate(x) for x in zip(self.low, self.digest, strict=True))
        self.keys = Merged(name, check, np.concatenate([batch.ids[batch.doc], batch.ids[self.whole]]), buckets)

    def take_keys(self, replies: dict) -> None:
        """Copies of smaller documents, and the runs whose key another document has."""
        batch = self.batch
        earlier, shared = self.keys.answers(replies)
        at = self.keys.find(*self.digest)
        self.copy = np.zeros(len(batch.ids), bool)
        self.copy[self.whole] = earlier[at] | (self.keys.least[at] < batch.ids[self.whole])
        self.open = np.flatnonzero(shared[self.keys.find(*self.low)] & ~self.copy[batch.doc])
        self.sign = batch.signatures(self.open)
        self.signs = Merged(*self.sign, batch.ids[batch.doc[self.open]], self.buckets, batch.low[self.open])

    def take_signs(self, replies: dict) -> None:
        """Runs that a smaller document has whole, and the strings of those that must be looked at one by one."""
        batch = self.batch
        earlier, mixed = self.signs.answers(replies)
        at = self.signs.find(*self.sign)
        own = batch.ids[batch.doc[self.open]]
        taken = earlier[at] | (self.signs.least[at] < own)
        self.taken = self.open[taken]
        unclear = self.open[mixed[at] & ~taken]
        first, last = batch.first[unclear], batch.last[unclear]
        self.which = spread(first, last)
        self.own = np.repeat(batch.ids[batch.doc[unclear]], last - first + 1)
        self.name = batch.strings(self.which)
        self.singles = Merged(*self.name, self.own, self.buckets)

    def lost(self, replies: dict) -> np.ndarray:
        """For each byte of the batch whether it goes; copies are not marked."""
        batch = self.batch
        earlier, _ = self.singles.answers(replies)
        at = self.singles.find(*self.name)
        gone = self.which[earlier[at] | (self.singles.least[at] < self.own)]
        size = len(batch.data) + 1
        starts = np.concatenate([batch.first[self.taken], gone])
        ends = np.concatenate([batch.last[self.taken], gone]) + LENGTH
        depth = np.bincount(starts, minlength=size) - np.bincount(ends, minlength=size)[:size]
        return np.cumsum(depth[:-1]) > 0


def _ask(work: DataFrame, send, name: str) -> str:
    """Send names to their buckets, and keep the answers by part of the work table."""
    spark = work.sparkSession
    sent = work.mapInPandas(send, SENT)
    path = scratch_path(spark, name)
    got = sent.groupBy("bucket").applyInPandas(_sorted_bucket, REPLY)
    got.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end byte of each maximal removed run), kept (remaining bytes)."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId() << 24, 0
        ids, texts, size = [], [], 0

        def row() -> pd.DataFrame:
            sizes = np.array([len(t) for t in texts], np.int64)
            return pd.DataFrame([(part + k, np.array(ids, np.int64).tobytes(), sizes.tobytes(), b"".join(texts), size)], columns=["batch", "ids", "sizes", "data", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = text.encode("utf-8") if text else b""
                ids.append(NO_ID if doc_id is None else int(doc_id))
                texts.append(own)
                size += len(own)
                if size >= BATCH_BYTES or len(ids) >= 50_000:
                    yield row()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield row()

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    work = staged(rows.mapInPandas(gather, "batch long, ids binary, sizes binary, data binary, n long"), "suffix-work")
    total = work.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))

    def batches_of(frames: Iterator[pd.DataFrame], *answers: str) -> Iterator[tuple[int, _Rounds, list[dict]]]:
        replies = [_Replies(x) for x in answers]
        for frame in frames:
            for _, row in frame.iterrows():
                k = int(row["batch"])
                yield k, _Rounds(Batch(row), buckets), [r.of(k) for r in replies]

    def send_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, rounds, _ in batches_of(frames):
            yield rounds.keys.rows(k)

    first = _ask(work, send_keys, "suffix-keys")

    def send_signs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, rounds, (a,) in batches_of(frames, first):
            rounds.take_keys(a)
            yield rounds.signs.rows(k, keyed=True)

    second = _ask(work, send_signs, "suffix-signs")

    def send_singles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, rounds, (a, b) in batches_of(frames, first, second):
            rounds.take_keys(a)
            rounds.take_signs(b)
            yield rounds.singles.rows(k)

    third = _ask(work, send_singles, "suffix-singles")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rounds, (a, b, c) in batches_of(frames, first, second, third):
            rounds.take_keys(a)
            rounds.take_signs(b)
            batch, lost, out = rounds.batch, rounds.lost(c), []
            for i, doc_id in enumerate(batch.ids):
                lo, hi = batch.at[i], batch.at[i + 1]
                flags = np.ones(hi - lo, bool) if rounds.copy[i] else lost[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                out.append((None if doc_id == NO_ID else str(doc_id), int(hi - lo), spans, batch.data[lo:hi][~flags].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])

    got = work.mapInPandas(cut, "doc_id string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
