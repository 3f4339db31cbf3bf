"""A binary arena of edges (S36): a header and fixed records, each at a multiple of 64 bytes.

A blob holds one bucket of edges; blobs are independent, so an arena of any size is written and read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIGNMENT, MAGIC = 64, b"PLA1"
_HEADER = struct.Struct("<4sIQ")
_RECORD = struct.Struct("<18s18s12sQd")
_EDGE = "src string, dst string, kind string, n bigint, weight double"


def pack(edges: list[tuple[str, str, str, int, float]]) -> bytes:
    """The blob of the edges in order; ids of more than 18 and kinds of more than 12 bytes are refused."""
    parts = [_HEADER.pack(MAGIC, ALIGNMENT, len(edges)).ljust(ALIGNMENT, b"\0")]
    for src, dst, kind, n, weight in edges:
        texts = [t.encode() for t in (src, dst, kind)]
        if any(len(t) > room for t, room in zip(texts, (18, 18, 12))):
            raise ValueError(f"too long for a record: {src}, {dst}, {kind}")
        parts.append(_RECORD.pack(*texts, n, weight).ljust(ALIGNMENT, b"\0"))
    return b"".join(parts)


def unpack(blob: bytes) -> list[tuple[str, str, str, int, float]]:
    """The edges of a blob; a blob that is cut, padded or of another format is refused."""
    if len(blob) < ALIGNMENT or blob[:4] != MAGIC:
        raise ValueError("no arena")
    _, alignment, count = _HEADER.unpack_from(blob)
    if alignment != ALIGNMENT or len(blob) != ALIGNMENT * (count + 1):
        raise ValueError("arena of another length than its header says")
    found = (_RECORD.unpack_from(blob, ALIGNMENT * (i + 1)) for i in range(count))
    return [(*(t.rstrip(b"\0").decode() for t in (src, dst, kind)), n, weight) for src, dst, kind, n, weight in found]


def blobs(edges: DataFrame, digits: int = 3) -> DataFrame:
    """(bucket, blob): the edges by the first digits of their source's digest, sorted in each blob."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["src", "dst", "kind"])
        return pd.DataFrame([(key[0], pack(list(ordered[["src", "dst", "kind", "n", "weight"]].itertuples(index=False, name=None))))], columns=["bucket", "blob"])

    return edges.withColumn("bucket", F.substring(F.sha2("src", 256), 1, digits)).groupBy("bucket").applyInPandas(write, "bucket string, blob binary")


def edges_of(table: DataFrame) -> DataFrame:
    """The edges of a table of blobs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([e for blob in batch["blob"] for e in unpack(bytes(blob))], columns=["src", "dst", "kind", "n", "weight"])

    return table.select("blob").mapInPandas(read, _EDGE)
