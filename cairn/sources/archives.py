"""Archives: tar pack and unpack, compressibility, layout records, codec sniffing."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample bytes and least ratio of a compressible part.
SAMPLE_BYTES, LEAST_RATIO = 100_000, 1.10


def codec(content: Column) -> Column:
    """gzip, zstd or tar by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("1F8B"), F.lit("gzip")).when(head == "28B52FFD", F.lit("zstd")).otherwise(F.lit("tar"))


def compressible(docs: DataFrame) -> DataFrame:
    """(doc_id, ratio, compressible) by the codec's gain on the sample that the rule names."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda b: len(b) / max(1, len(zlib.compress(b, 6))) if b else 1.0)

    r = docs.select("doc_id", ratio(F.substring(F.encode("text", "utf-8"), 1, SAMPLE_BYTES)).alias("ratio"))
    return r.withColumn("compressible", F.col("ratio") >= LEAST_RATIO)


def pack(files: DataFrame) -> DataFrame:
    """(archive, content) of files(archive, path, content): reproducible gzip tars, entries by path, epoch times."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in pdf.sort_values("path").itertuples():
                info = tarfile.TarInfo(r.path)
                info.size, info.mtime, info.mode = len(r.content), 0, 0o666
                tar.addfile(info, io.BytesIO(r.content))
        return pd.DataFrame({"archive": [pdf.archive.iloc[0]], "content": [gzip.compress(out.getvalue(), mtime=0)]})

    return files.groupBy("archive").applyInPandas(one, "archive int, content binary")


def unpack(archives: DataFrame) -> DataFrame:
    """(path, content) of every file of archives(content), of any codec; directories are skipped."""

    def run(batches):
        import zstandard

        for pdf in batches:
            for raw in pdf.content:
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                elif raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    files = [(m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pd.DataFrame(files, columns=["path", "content"])

    return archives.select("content").mapInPandas(run, "path string, content binary")


def layout_records(entries: DataFrame) -> DataFrame:
    """(kind, digest, size) of layout entries(path, content): digests come from the path and are verified."""
    p = F.regexp_replace("path", r"^\./", "")
    digest = F.concat_ws(":", F.regexp_extract(p, r"blobs/([^/]+)/([^/]+)$", 1), F.regexp_extract(p, r"blobs/([^/]+)/([^/]+)$", 2))
    kind = F.when(p == "oci-layout", "layout").when(p == "index.json", "index").when(p.rlike("^blobs/[^/]+/[^/]+$"), "blob").otherwise("other")
    ok = (kind != "blob") | (digest == F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    return entries.select(kind.alias("kind"), F.when(kind == "blob", digest).alias("digest"), F.octet_length("content").cast("long").alias("size"), ok.alias("ok"))
