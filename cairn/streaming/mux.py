"""Interleaved streams as frames: little-endian u32 stream id, u64 length, payload."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = "<IQ"


def mux(parts: DataFrame) -> DataFrame:
    """(stream, seq, frame) of parts(stream, seq, payload)."""

    @F.pandas_udf("binary")
    def frame(stream: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(HEADER, s, len(p)) + p for s, p in zip(stream, payload, strict=True)])

    return parts.select("seq", frame("stream", "payload").alias("frame"))


def demux(frames: DataFrame) -> DataFrame:
    """(stream, payload) of frames(seq, frame): payloads of a stream joined in order."""

    @F.pandas_udf("stream long, payload binary")
    def split(f: pd.Series) -> pd.DataFrame:
        out = []
        for b in f:
            s, n = struct.unpack_from(HEADER, b)
            if len(b) != struct.calcsize(HEADER) + n:
                raise ValueError("a frame's length is wrong")
            out.append((s, b[struct.calcsize(HEADER) :]))
        return pd.DataFrame(out, columns=["stream", "payload"])

    x = frames.select("seq", split("frame").alias("x")).select("seq", "x.*")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "payload"))), lambda p: F.hex(p["payload"]))
    return x.groupBy("stream").agg(F.unhex(F.array_join(ordered, "")).alias("payload"))
