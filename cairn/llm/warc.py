"""Deterministic sharded WARC writer, and its reader.

Records are ordered by page_id. Histograms of payload bytes over the id's bits, ``BITS`` of them at a time from the first in which
ids differ, and finer where a range holds more than a shard, give contiguous shards of near equal
size, whatever lies between the ids: a bounded list of first ids. A shard's records are
sorted and written by one task into gzip members, a file being rolled when its compressed size
passes ``roll_bytes``. Headers are generated anew, digests computed from the payload. A file is
written under a temporary name of its task attempt and renamed when it is whole; a shard's files are listed with
their sizes and SHA-256 in the shard's part of the manifest, written the same way, after them. A small marker with the number of shards,
files and records, itself renamed into place, commits the archive. A lost executor's shard is written again to the same names with
the same bytes. Readers open what the parts of the manifest list and nothing else.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs), so the folder must be one
that all executors share.

Payloads of at least ``least_bytes`` that are equal: the record with the largest page_id is the
response, the others revisit it. Smaller payloads are all responses. Nulls: html null is an empty
payload, url null is an empty target, page_id null sorts first, is
always a response and is never referred to. Repeated
rows of the same page_id are each a record, in order of payload and url; rows with the largest id are all responses. An empty
table gives an archive without files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, n_parts, start_task

#: Bits of the id that one histogram tells apart.
BITS = 14
SHARD_BYTES = 8 << 20
MAX_SHARDS = 50_000
ROLL_BYTES = 4 << 20
LEAST_BYTES = 1000
MARKER = "archive.json"
FILES = "shard int, seq int, file string, records long, bytes long, sha256 string, first_id long, last_id long"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the headers of its response and no payload."""
    sha = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Files of one shard."""

    def __init__(self, uri: str, shard: int, roll: int, attempt: str):
        self.fs, self.dir = open_fs(uri)
        self.shard, self.roll, self.attempt = shard, roll, attempt
        self.seq, self.out, self.done = 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.tmp = f"{self.dir}/_tmp-{self.attempt}-{self.name}"
            self.out, self.sha, self.size, self.n, self.first = self.fs.open_output_stream(self.tmp, compression=None), hashlib.sha256(), 0, 0, page_id
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, f"{self.dir}/{self.name}")
            self.done.append((self.shard, self.seq, self.name, self.n, self.size, self.sha.hexdigest(), self.first, self.last))
            self.seq, self.out = self.seq + 1, None


def put(fs, path: str, data: bytes, attempt: str) -> None:
    """A small file, whole or not at all."""
    top, _, name = path.rpartition("/")
    with fs.open_output_stream(f"{top}/_tmp-{attempt}-{name}", compression=None) as out:
        out.write(data)
    fs.move(f"{top}/_tmp-{attempt}-{name}", path)


def first_ids(sizes: DataFrame, unit: int, bits: int = BITS) -> list[int]:
    """First id of each shard but the first, ascending, of sizes(page_id, size): shards of about ``unit`` bytes, or of one id."""
    lo, hi = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if lo is None:
        return []
    # As an unsigned number in the same order: the sign bit is turned.
    flip = F.col("page_id").bitwiseXOR(F.lit(-(2**63)))
    low, high = lo + 2**63, hi + 2**63
    shift = max(0, (low ^ high).bit_length() - bits)
    cuts, have, leaves = [], 0, []
    count = lambda df, s: [(r[0] % 2 ** (64 - s), int(r[1]), s) for r in df.groupBy(F.shiftrightunsigned(flip, s)).agg(F.sum("size")).collect()]
    todo = count(sizes.where("page_id is not null"), shift)  # at most 2**bits rows, by the leading bits of their ids
    while todo:
        heavy = [p for p, n, s in todo if n > unit and s > 0]  # at most total / unit
        leaves += [(p << s, n) for p, n, s in todo if n <= unit or s == 0]
        if not heavy:
            break
        s = todo[0][2]
        of = sizes.sparkSession.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in heavy], "p long")
        # Together some 2**20 rows come back.
        todo = count(sizes.withColumn("p", F.shiftrightunsigned(flip, s)).join(F.broadcast(of), "p", "left_semi"), max(0, s - max(2, min(bits, 20 - len(heavy).bit_length()))))
    for at, n in sorted(leaves):
        if have and have + n > unit:
            cuts.append(at - 2**63)
            have = 0
        have += n
    return cuts


def write_warc(pages: DataFrame, uri: str, scratch: Scratch, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> dict:
    """Write pages(page_id, url, html) below uri; returns the marker: shards, files, records, bytes."""
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("size", F.octet_length("html"))
    # Few payloads repeat: only rows that revisit carry a reference to the sort below.
    p = p.withColumn("sha", F.when(F.col("size") >= least_bytes, F.sha1("html")))
    known = scratch.save(p.select("page_id", "size", "sha"), "known")
    first = scratch.save(known.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").select("sha", "to"), "first")
    refs = scratch.save(known.where("page_id is not null").join(first, "sha").where("page_id <> to").select("page_id", "sha", "to").distinct(), "refs")
    fs, path = open_fs(uri)
    fs.create_dir(f"{path}/manifest", recursive=True)
    total, n_refs = known.agg(F.sum("size")).first()[0] or 0, refs.count()
    cuts = np.array(first_ids(known.select("page_id", F.col("size").cast("long")), max(shard_bytes, -(-total // MAX_SHARDS))), np.int64)
    shards = len(cuts) + 1 if known.limit(1).count() else 0

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:  # null ids come to the first shard
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(-(2**63)).astype("int64"), "right")).astype(np.int32))

    q = p.withColumn("shard", shard_of("page_id"))
    q = q.join(refs, ["page_id", "sha"], "left") if n_refs else q.withColumn("to", F.lit(None).cast("long"))
    q = q.repartition(max(n_parts(spark), min(shards, 100_000)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "html", "url").select("shard", "page_id", "url", "html", "to")

    def write(batches):
        start_task()
        attempt = f"{TaskContext.get().taskAttemptId()}" if TaskContext.get() else "0"
        store, top = open_fs(uri)
        at = None

        def listed(at):
            at.close()
            rows = [dict(zip(("shard", "seq", "file", "records", "bytes", "sha256", "first_id", "last_id"), r, strict=True)) for r in at.done]
            put(store, part_path(top, at.shard), json.dumps(rows, sort_keys=True).encode(), attempt)
            return pa.RecordBatch.from_arrays([pa.array([sum(r[k] for r in rows) if k else len(rows)]) for k in ("", "records", "bytes")], ["files", "records", "bytes"])

        for batch in batches:
            for s, i, u, h, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at.shard != s:
                    if at is not None:
                        yield listed(at)
                    at = Roller(uri, s, roll_bytes, attempt)
                at.add(i, record(i, u, h.encode("utf-8"), to))
        if at is not None:
            yield listed(at)

    done = q.mapInArrow(write, "files long, records long, bytes long").agg(F.count("*"), F.sum("files"), F.sum("records"), F.sum("bytes")).first()
    marker = {"shards": shards, "written": done[0], "files": done[1] or 0, "records": done[2] or 0, "bytes": done[3] or 0}
    put(fs, f"{path}/{MARKER}", json.dumps(marker, sort_keys=True).encode(), "commit")
    return marker


def part_path(top: str, shard: int) -> str:
    return f"{top}/manifest/shard-{shard:06d}.json"


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """FILES of a committed archive, read by the executors from the parts of its manifest."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(f"{path}/{MARKER}") as f:
        marker = json.loads(f.read())
    shards = spark.range(marker["shards"]).repartition(max(1, min(marker["shards"], 4096)))

    def read(batches):
        store, top = open_fs(uri)
        for batch in batches:
            rows = []
            for s in batch.column("id").to_pylist():
                with store.open_input_stream(part_path(top, s)) as f:
                    rows += json.loads(f.read())
            names = [c.split()[0] for c in FILES.split(", ")]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return shards.mapInArrow(read, FILES)


def parse(data) -> list[tuple]:
    """(page_id, url, type, refers_to, payload length, digest hex, payload) of each record of a gzip stream."""
    out = []
    while True:
        head = {}
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return out
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        block = data.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload of {head['warc-record-id']}")
        number = lambda x: int(x) if x else None
        refers = head.get("warc-refers-to")
        out.append((number(head["warc-record-id"][10:-1]), head["warc-target-uri"], kind, number(refers[10:-1]) if refers else None, n, digest, payload if kind == "response" else None))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """Every record of an archive, files and digests checked: READ."""
    names = manifest(spark, uri).select("file", "sha256")

    def read(batches):
        store, top = open_fs(uri)
        for batch in batches:
            for name, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{top}/{name}", compression=None) as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"damaged file {name}")
                rows = parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))))
                cols = [[r[k] for r in rows] for k in (0, 4, 5, 2, 3, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return names.mapInArrow(read, READ)
