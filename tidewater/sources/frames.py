"""A frame archive: length-prefixed, digested records of raw bytes, readable by Spark."""

from __future__ import annotations

import gzip
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Sequence number, receive time in microseconds, length; then sha256 and the bytes.
_HEAD = struct.Struct(">QQI")


def write_frames(path: str, frames: Iterable[tuple[int, int, bytes]]) -> None:
    """Write (seq, received_us, bytes) records."""
    with gzip.open(path, "wb") as out:
        for seq, at, data in frames:
            out.write(_HEAD.pack(seq, at, len(data)) + hashlib.sha256(data).digest() + data)


def decode_frames(raw: bytes) -> Iterator[tuple[int, int, bytes, str | None]]:
    """(seq, received_us, bytes, fault) of an archive; a cut-off end or a wrong digest is a fault, not an error."""
    at = 0
    while at < len(raw):
        if at + _HEAD.size + 32 > len(raw):
            yield -1, 0, b"", "TRUNCATED"
            return
        seq, received, n = _HEAD.unpack_from(raw, at)
        digest, data = raw[at + _HEAD.size : at + _HEAD.size + 32], raw[at + _HEAD.size + 32 : at + _HEAD.size + 32 + n]
        if len(data) < n:
            yield seq, received, data, "TRUNCATED"
            return
        yield seq, received, data, None if hashlib.sha256(data).digest() == digest else "DIGEST_MISMATCH"
        at += _HEAD.size + 32 + n


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``shard, seq, received_us, data, fault``: one task per archive file; a file's records stream out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in pdf[["path", "content"]].itertuples(index=False):
                rows = []
                for record in decode_frames(gzip.decompress(content)):
                    rows.append((name, *record))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["shard", "seq", "received_us", "data", "fault"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["shard", "seq", "received_us", "data", "fault"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "shard string, seq long, received_us long, data binary, fault string")
