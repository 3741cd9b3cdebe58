"""Helpers of the training-data operators: shared folders, Arrow text buffers, vectorised span hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from augmill.session import ensure_checkpoint_dir

#: Bytes of text that a vectorised kernel handles at once.
CHUNK_BYTES = 1 << 21
#: Of these, bytes that a kernel with many arrays a byte handles at once.
BLOCK_BYTES = 1 << 19


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once no plan that still has to run reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# Span hashes: a polynomial over the bytes modulo 2^64 with an odd base, from prefix
# sums, so that the hash of any span costs two lookups. Two spans with equal bytes get
# equal hashes wherever they stand.

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_values(seed: int) -> np.ndarray:
    """256 odd pseudo-random 64-bit values, the same on every machine."""
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1009)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = next((x for x in (BLOCK_BYTES + 1, CHUNK_BYTES + 1) if n <= x), n)
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


class SpanHash:
    """Hashes of spans [start, end) of one byte buffer."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of True in ``member`` that don't cross row ends."""
    n = len(member)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True  # the place after the last byte may be the start of empty rows
    begins = member.copy()
    begins[1:] &= ~member[:-1] | first[1:n]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1
