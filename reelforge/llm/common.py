"""Shared helpers of the subpackage: intermediate tables in the cluster's
shared folder and vectorised word handling over Arrow string columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside the ASCII blanks (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once by the vectorised helpers (a longer text goes alone).
SLICE_BYTES = 1 << 19


# --- intermediate tables -------------------------------------------------

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a scratch folder;
    on a cluster a missing setting is an error, never a machine-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="reelforge-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage durably."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in the order in which the rows were written: by number of
    the part file and row.  A scan deals files to tasks by size instead.  A
    frame that is not read from files has its own order and is left so."""
    try:
        docs.select("_metadata.row_index").schema
    except Exception as e:  # not read from files: Spark names the missing column
        if "_metadata" not in str(e):
            raise
        return docs.select(*columns)
    name = F.col("_metadata.file_name")
    order = ["_fo_part", "_fo_file", "_fo_row"]
    return (docs.select(*columns, F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long").alias("_fo_part"),
                        F.col("_metadata.file_path").alias("_fo_file"), F.col("_metadata.row_index").alias("_fo_row"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select(*columns))


def fold(column, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % mod


# --- words over Arrow columns --------------------------------------------

def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) over the rows of a string column; only one
    slice at a time is copied."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in slices(np.concatenate([[0], np.cumsum(sizes)]), limit):
        data, offsets = utf8(column.slice(lo, hi - lo))
        yield lo, hi, data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of True in ``inside`` that stays in one row."""
    n = len(inside)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _powers[size]
    return up[:n], down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes everywhere."""
    up, down = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hash(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of n words in one row."""
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(rows[:len(rows) - n + 1] == rows[n - 1:])
    out = np.full(len(first), np.uint64(n))
    for j in range(n):
        out = mix64(out * _P + words[first + j])
    return first, out
