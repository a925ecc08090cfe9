"""Codecs of blobs: the choice by name, encoding, decoding by media type, sizes and digests of both forms."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codec levels of archives; any other name leaves content as it is.
LEVELS = {"zstd": 11, "gzip": 9}


def chosen(name: Column) -> Column:
    """zstd, gzip, or empty for every other name."""
    return F.when(name.isin(*LEVELS), name).otherwise(F.lit(""))


def _coded(content: Column, codec: Column, zstd, gzipped) -> Column:
    """Content through zstd() or gzipped by its codec's name. The function goes to the workers by value: they need no copy of this package."""

    def run(raws: pd.Series, names: pd.Series) -> pd.Series:
        by = {"zstd": zstd(), "gzip": gzipped}
        return pd.Series([r if r is None or n not in by else by[n](r) for r, n in zip(raws, names, strict=True)], dtype=object)

    return F.pandas_udf(run, T.BinaryType())(content, codec)


def encode(content: Column, codec: Column) -> Column:
    """Content in a codec; the same bytes at every run. An unknown codec changes nothing, null stays null."""
    levels = dict(LEVELS)

    def zstd():
        import zstandard

        return zstandard.ZstdCompressor(level=levels["zstd"]).compress

    return _coded(content, codec, zstd, lambda raw: gzip.compress(raw, levels["gzip"], mtime=0))


def decode(content: Column, codec: Column) -> Column:
    """Content out of a codec; content that is not in it is an error."""

    def zstd():
        import zstandard

        return lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)

    return _coded(content, codec, zstd, lambda raw: gzip.decompress(raw))


def part_form(media_type: Column) -> Column:
    """How a part is kept, by the suffix of its media type: tar, tar+zstd, zstd or raw; null for a type that is not known."""
    known = [F.when(media_type.endswith(s), F.lit(form)) for s, form in (("tar+zstd", "tar+zstd"), ("+zstd", "zstd"), ("tar", "tar"), ("raw", "raw"))]
    return F.coalesce(*known)


def part_content(content: Column, media_type: Column) -> Column:
    """A part's bytes as they are on disk, a tar still packed; gzip is not implemented and an unknown type is an error."""
    form = part_form(media_type)
    wrong = F.raise_error(F.concat(F.when(media_type.endswith("gzip"), "gzip is not implemented: ").otherwise("unknown layer media type: "), F.coalesce(media_type, F.lit("none")))).cast("binary")
    return F.when(form.isNull(), wrong).otherwise(decode(content, F.when(form.endswith("zstd"), "zstd").otherwise("")))


def measured(content: Column, codec: Column) -> Column:
    """struct(size, digest, layer, layer_size, layer_digest) of content and of its encoded form, the layer, in one pass."""
    layer = encode(content, chosen(codec))
    size = lambda c: F.octet_length(c).cast("long")
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    return F.struct(size(content).alias("size"), sha(content).alias("digest"), layer.alias("layer"), size(layer).alias("layer_size"), sha(layer).alias("layer_digest"))
