"""WARC archives: a deterministic sharded writer, and a reader.

The same pages give the same files, byte for byte. Shards are ranges of page ids of about ``SHARD_BYTES`` of payload each, or
more where that would make over ``MOST_SHARDS``; their bounds follow from a histogram of bytes over ids that is refined where ids
crowd, at most ``MOST_BINS`` ranges in a pass. An id that is heavier than a shard, or the rows without one, are cut by digest. A task sorts its shard by id,
writes gzip members with freshly computed headers, lengths and digests, and starts a new file once the current one
has reached ``ROLL_BYTES`` compressed. Files are written under names of their task attempt; the rows that name them become a
manifest, which Spark commits for one attempt of each task; a second step gives the files of the manifest their final names
and can be repeated. Readers open what the manifest lists and nothing else, so files of lost attempts are never seen.

Of pages whose payloads are equal and of ``MIN_REVISIT`` bytes or more, the one with the largest id is a response and the
others are revisits of it. Which they are is found on ids and digests alone; the payload is moved once.

Defined results: a null payload is an empty one; a page without an id is written as any other and sorts first; rows
equal in id and payload are all of the same type; a null url has no target line; control characters in urls are
percent-encoded; an empty table gives an empty archive; only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, staged, table

MIN_REVISIT = 1000
SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
BINS = 1024
MOST_SHARDS = 1 << 16
MOST_BINS = 1 << 18
READ_TASKS = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"


def open_fs(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if re.match(r"[a-z0-9]+://", path) else re.sub("^file:", "", path))


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _member(lines: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        lines.append(("X-Page-Id", page_id))
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    block = http + payload
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
        block = http
    return _member([*lines, ("WARC-Block-Digest", _sha1(block))], block)


class _Roller:
    """Files of one shard, each begun with a warcinfo record."""

    def __init__(self, root: str, shard: int, attempt: str, roll: int) -> None:
        self.fs, self.root = open_fs(root)
        self.shard, self.attempt, self.roll, self.seq, self.out = shard, attempt, roll, 0, None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            folder = f"{self.root}/_temporary/{self.attempt}"
            self.fs.create_dir(folder, recursive=True)
            self.temp = f"_temporary/{self.attempt}/{self.name}"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(f"{folder}/{self.name}", compression=None), hashlib.sha256(), 0, 0
            info = f"software: pagedelta\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.shard}\r\n".encode()
            lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, "")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_member(lines, info))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        row = (self.shard, self.seq, self.temp, self.name, self.records, self.bytes, self.sha.hexdigest())
        self.out, self.seq = None, self.seq + 1
        return row

    def full(self) -> bool:
        return self.out is not None and self.bytes >= self.roll


def _weigh(sizes: DataFrame, bins: list[tuple[int, int]]) -> dict[int, int]:
    """Bytes of each range of ids (first, last) that has any; ``MOST_BINS`` rows at most."""
    starts, ends = np.array(bins, np.int64).T

    @F.pandas_udf("int")
    def bin_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, ids.to_numpy(np.int64), "right") - 1
        return pd.Series(np.where((at >= 0) & (ids.to_numpy(np.int64) <= ends[at]), at, -1).astype(np.int32))

    got = sizes.filter(F.col("id").isNotNull()).groupBy(bin_of("id").alias("k")).agg(F.sum("bytes").alias("n")).collect()
    return {r["k"]: r["n"] for r in got}


@dataclass
class Shards:
    """``bounds``: first ids of the ranges but the first; ``cuts``: shards of each range, of which the first is that of rows without id."""

    bounds: np.ndarray
    cuts: np.ndarray

    @property
    def n(self) -> int:
        return int(self.cuts.sum())

    def of(self, ids: pd.Series, digests: pd.Series) -> np.ndarray:
        """The shard of each row; in the order of ids, and of digests within an id."""
        at = np.searchsorted(self.bounds, ids.fillna(0).to_numpy(np.int64), "right") + 1
        at[ids.isna().to_numpy()] = 0
        cuts = self.cuts[at]
        first = np.cumsum(self.cuts) - self.cuts
        part = np.zeros(len(at), np.int64)
        for k in np.flatnonzero(cuts > 1):
            part[k] = int(digests.iloc[k][:8], 16) * int(cuts[k]) >> 32
        return first[at] + part


def plan_shards(sizes: DataFrame, most: int = SHARD_BYTES) -> Shards:
    """Shards for ``sizes``: id, bytes."""
    null = F.sum(F.when(F.col("id").isNull(), F.col("bytes")))
    ends = sizes.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.sum("bytes").alias("n"), null.alias("null"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    most = max(most, -(-(ends["n"] or 0) // MOST_SHARDS), 1)
    cuts = [max(1, -(-(ends["null"] or 0) // most)) if ends["nulls"] else 0]
    if ends["a"] is None:
        return Shards(np.zeros(0, np.int64), np.array([*cuts, 1], np.int64))
    open_, done = [(ends["a"], ends["b"])], []
    while open_:  # all ranges that are too heavy are refined in one pass; a range one id wide stays as it is
        pieces = max(2, min(BINS, MOST_BINS // len(open_)))
        bins = []
        for a, b in open_:
            step = -(-(b - a + 1) // pieces)
            bins += [(x, min(x + step - 1, b)) for x in range(a, b + 1, step)]
        weight = _weigh(sizes, bins)
        open_ = [x for k, x in enumerate(bins) if weight.get(k, 0) > most and x[0] < x[1]]
        spent = set(open_)
        done += [(*x, weight.get(k, 0)) for k, x in enumerate(bins) if x not in spent]
    bounds, size = [], 0
    cuts.append(1)
    for a, b, n in sorted(done):
        if n > most and a == b or size + n > most:  # an id heavier than a shard has a range of its own
            if size:
                bounds.append(a)
                cuts.append(1)
            size = 0
        size += n
        if n > most:
            cuts[-1], size = -(-n // most), most
    return Shards(np.array(bounds, np.int64), np.array(cuts, np.int64))


def write_archive(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write page_id, url, html to WARC files under ``root``; returns the manifest, which is also at ``root/_manifest``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.col("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    slim = staged(rows.select(F.col("page_id").cast("long").alias("id"), "digest", F.col("n").cast("long").alias("bytes")), "warc-slim")
    large = slim.filter(F.col("bytes") >= MIN_REVISIT)
    kept = large.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    marks = large.join(staged(kept.select("digest", "keep"), "warc-kept"), "digest").filter("keep IS NOT NULL AND NOT id <=> keep")
    shards = plan_shards(slim, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(shards.of(ids, digests).astype(np.int32))

    text = lambda c: F.col(c).cast("string")
    full = rows.select(F.col("page_id").cast("long").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"), "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keep"))
    marked = marks.distinct().select("id", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "digest", F.lit(0).alias("kind"), "keep")
    both = full.unionByName(marked).withColumn("shard", shard_of(F.col("id"), F.col("digest")))
    both = both.repartitionById(shards.n, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "kind", "url")
    both = both.select("shard", text("id").alias("id"), "url", "html", "digest", "kind", text("keep").alias("keep"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        roller, out, mark = None, [], None
        for batch in batches:
            for shard, id_, url, html, digest, kind, keep in batch.itertuples(index=False):
                if kind == 0:
                    mark = (id_, digest, keep)
                    continue
                if roller is None or roller.shard != shard:
                    if roller is not None and roller.out is not None:
                        out.append(roller.close())
                    roller = _Roller(root, shard, attempt, roll_bytes)
                refers = mark[2] if mark and mark[:2] == (id_, digest) else None
                roller.write(record(id_, url, html.encode("utf-8"), digest, refers))
                if roller.full():
                    out.append(roller.close())
        if roller is not None and roller.out is not None:
            out.append(roller.close())
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        fs, top = open_fs(root)
        for batch in batches:
            for temp, name in zip(batch["temp"], batch["name"], strict=True):
                if fs.get_file_info(f"{top}/{temp}").type == FileType.File:
                    fs.move(f"{top}/{temp}", f"{top}/{name}")
                elif fs.get_file_info(f"{top}/{name}").type != FileType.File:
                    raise FileNotFoundError(f"{top}/{name}")
            yield batch

    both.mapInPandas(write, MANIFEST).write.parquet(f"{root}/_written")
    written = spark.read.parquet(f"{root}/_written")
    written.repartition(max(1, min(64, written.count())), "name").mapInPandas(commit, MANIFEST).write.parquet(f"{root}/_manifest")
    fs, top = open_fs(root)
    for spent in ("_temporary", "_written"):
        if fs.get_file_info(f"{top}/{spent}").type.name == "Directory":
            fs.delete_dir(f"{top}/{spent}")
    return spark.read.parquet(f"{root}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise EOFError("the last member is cut off")
            return
        parts.append(z.decompress(data))
        data = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, and its block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a record: {version[:20]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archive(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; without ``payloads`` they are read and verified, not returned."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = open_fs(root)
        whole = lambda x: pd.array(x, dtype="Int64")

        def frame(rows: list[tuple]) -> pd.DataFrame:
            c = list(zip(*rows, strict=True)) or [()] * 7
            return pd.DataFrame({"page_id": whole(c[0]), "url": pd.Series(c[1], dtype=object), "record_type": pd.Series(c[2], dtype=object), "payload_bytes": whole(c[3]), "payload_digest": pd.Series(c[4], dtype=object), "refers_to": whole(c[5]), "payload": pd.Series(c[6], dtype=object)})

        for batch in batches:
            for name in batch["name"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for member in members(stream):
                        f, block = parse(member)
                        if _sha1(block) != f.get("WARC-Block-Digest", _sha1(block)):
                            raise ValueError(f"{name}: damaged block in {f['WARC-Record-ID']}")
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2]
                        stated = base64.b32decode(f["WARC-Payload-Digest"].partition(":")[2]).hex()
                        is_response = f["WARC-Type"] == "response"
                        if is_response and hashlib.sha1(body).hexdigest() != stated:
                            raise ValueError(f"{name}: damaged payload in {f['WARC-Record-ID']}")
                        n = len(body) if is_response else int(f["X-Payload-Length"])
                        as_int = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                        rows.append((as_int("X-Page-Id"), f.get("WARC-Target-URI"), f["WARC-Type"], n, stated, as_int("X-Refers-To-Page-Id"), body if payloads and is_response else None))
                        size += len(body) if payloads else 100
                        if size > 8 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                yield frame(rows)

    files = spark.read.parquet(f"{root}/_manifest").select("name")
    n = max(1, min(files.count(), READ_TASKS))
    return files.repartition(n, "name").mapInPandas(read, READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root, payloads=False).drop("payload", "url")


OP3_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM k
"""
