"""Helpers the training-data operators share: tables, stages, Arrow passes and vectorised byte hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import drop_folder, new_folder

MIX_A, MIX_B, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


#: Bytes of an Arrow batch (the default of 64 MB is held several times over by a Python worker).
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. The session's Arrow batches are made small, since texts of very different length meet in them."""
    spark.conf.set(_BATCH, _BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside; as it was afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives a lost executor.

    The shuffle files of the write are removed when it ends, not when the driver happens to collect its garbage."""
    path = new_folder(df.sparkSession, name)
    with setting(df.sparkSession, _CLEANUP, "true"), setting(df.sparkSession, _BATCH, _BATCH_BYTES):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[written] = path
    return written


def drop_stage(*stages: DataFrame) -> None:
    """Remove written tables whose readers have written their own result."""
    for df in stages:
        drop_folder(df.sparkSession, _FOLDERS.pop(df))


def in_bytes(text: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def spare_name(df: DataFrame, name: str) -> str:
    """A working column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- Arrow batches as flat byte arrays ------------------------------------------------------------------------------

def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat_bytes = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat_bytes, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row runs of at most about ``most`` text bytes (a longer row comes alone) with their flat bytes and offsets."""
    for batch in batches:
        data, off = flat(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            lo = hi


def byte_class(pattern_bytes: bytes) -> np.ndarray:
    """Lookup table: True for the given byte values."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = byte_class(b" \t\n\x0b\x0c\r")
_PLAIN = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
NOT_WORD = byte_class(_PLAIN)


def spans(gap: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap``, cut at row borders."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(gap.take(data), out=word[1:-1])
    at = np.flatnonzero(word[1:] != word[:-1])
    start, end = at[::2], at[1::2]
    # a row border inside a run ends one and begins another
    cut = np.unique(off)
    cut = cut[word[cut] & word[cut + 1]]
    if len(cut):
        start, end = np.insert(start, np.searchsorted(start, cut), cut), np.insert(end, np.searchsorted(end, cut), cut)
    return start, end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, element-wise."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(MIX_A)
    y ^= y >> np.uint64(27)
    y *= np.uint64(MIX_B)
    y ^= y >> np.uint64(31)
    return y


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up = np.full(size, BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = hash of the first i bytes modulo 2^64."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= up[:len(data)]
    np.cumsum(x, out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span lies."""
    _, down = _powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
