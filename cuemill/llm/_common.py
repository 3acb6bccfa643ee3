"""Helpers shared by the corpus operators: scratch tables, Arrow access, word hashing."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; bounds its arrays, not the text.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch of a table that is written, about.
BATCH_BYTES = 8 << 20

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local default only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/cuemill"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the scratch root, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/cuemill-{uuid.uuid4().hex[:12]}-{label}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, a Python task gets its rows in batches of at most ``BATCH_BYTES``: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return what a task has freed to the system: Spark keeps Python workers, and the next task may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it, or what was derived from it, afterwards."""
    if df is not None:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- files written by tasks


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write under a hidden name, then move: readers never see half a file."""
    where, path = _store(folder)
    where.create_dir(path, recursive=True)
    hidden = f"{path}/.{name}.{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(hidden) as out:
        out.write(content)
    where.move(hidden, f"{path}/{name}")


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` (short) rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- Arrow text access


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row, if that alone is longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def batches_of(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches with their text bytes and offsets."""
    for batch in batches:
        data, offsets = text_parts(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in row_slices(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    give_back()


# ---------------------------------------------------------------- word hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of hashes behave like random numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: set[int]) -> np.ndarray:
    """Maps each byte to its lower-case form (A-Z only) or to 0 where it separates words."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[sorted(separators)] = 0
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, bytes_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and, for each row, the index of its first word (one more entry at the end).

    Work goes on in blocks that end between words, so a very long text needs no more memory than a
    block and its words.
    """
    hashes: list[np.ndarray] = []
    firsts: list[np.ndarray] = []
    n, lo, seen = len(data), 0, 0
    edges = offsets[1:-1]
    while lo < n:
        hi = min(n, lo + SLICE_BYTES)
        block = bytes_to[data[lo:hi]]
        while hi < n:
            inside = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            gaps = np.flatnonzero(block == 0)
            cut = max(inside, lo + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut > lo:
                hi = cut
                break
            more = min(n, hi + SLICE_BYTES)
            block, hi = np.concatenate([block, bytes_to[data[hi:more]]]), more
        block = block[: hi - lo]
        word = block != 0
        fresh = np.zeros(len(block) + 1, bool)
        fresh[0] = fresh[-1] = True
        near = edges[(edges > lo) & (edges < hi)] - lo
        fresh[near] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | fresh[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | fresh[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = _power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * up[: len(block)], out=sums[1:], dtype=np.uint64)
        raw = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        firsts.append(starts + lo)
        seen += len(starts)
        lo = hi
    at = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(at, offsets)


def without_rows(batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch that aren't marked in ``gone``."""
    return batch.filter(pa.array(~gone)) if gone.any() else batch


def size_class(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and total bytes of a string column, to decide whether it may be broadcast."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])
