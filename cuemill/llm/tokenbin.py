"""Token files with a shared zstandard dictionary.

A file holds one range of documents in ascending key order:

    magic "CMTB1\\0", u8 id width (2 or 4), u8 flags (1: a key is null), u64 number of documents,
    32 bytes SHA-256 of the dictionary, u32 dictionary length, the dictionary,
    index: i64 keys, u64 frame offsets (one more at the end), u32 id counts,
    then one zstandard frame per document (its little-endian ids).

All numbers are little-endian. One document is read with its index entry, its frame and the dictionary.
The dictionary is trained on the id arrays of a bounded sample of documents (``sample_docs`` rows with
texts of at most ``sample_chars`` characters, chosen by hash); every document is then written.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm._common import broadcast_if_small, put_file, scratch_path, small_batches
from cuemill.llm._tokens import encoder

MAGIC = b"CMTB1\0"
#: Serialized bytes of a file beyond which the next one begins.
FILE_BYTES = 16 << 20
_HEAD = struct.Struct("<6sBBQ32sI")


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary for short id arrays; with too few samples, their plain content; none without any."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


class TokenFileWriter:
    """Collects compressed documents of one file."""

    def __init__(self, dictionary: bytes, width: int = 2, level: int = 3):
        self.raw = dictionary
        self.width = width
        self.box = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        self.keys: list[int | None] = []
        self.frames: list[bytes] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        frame = self.box.compress(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.frames.append(frame)
        self.counts.append(len(ids))
        self.size += len(frame)

    def to_bytes(self) -> bytes:
        n = len(self.keys)
        flags = int(any(k is None for k in self.keys))
        keys = np.array([-(1 << 63) if k is None else k for k in self.keys], "<i8")
        offsets = np.zeros(n + 1, "<u8")
        offsets[1:] = np.cumsum([len(x) for x in self.frames])
        head = _HEAD.pack(MAGIC, self.width, flags, n, hashlib.sha256(self.raw).digest(), len(self.raw))
        return b"".join([head, self.raw, keys.tobytes(), offsets.tobytes(), np.array(self.counts, "<u4").tobytes(), *self.frames])


class TokenFile:
    """Reads documents of one file by position or key."""

    def __init__(self, content: bytes):
        magic, self.width, self.flags, n, digest, size = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        raw = content[_HEAD.size : _HEAD.size + size]
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError("the dictionary does not match its hash")
        at = _HEAD.size + size
        self.keys = np.frombuffer(content, "<i8", n, at)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 8 * n)
        self.counts = np.frombuffer(content, "<u4", n, at + 8 * n + 8 * (n + 1))
        self.base = at + 8 * n + 8 * (n + 1) + 4 * n
        self.content = memoryview(content)
        self.box = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if len(raw) >= 8 else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, k: int) -> int | None:
        value = int(self.keys[k])
        return None if self.flags and value == -(1 << 63) else value

    def ids(self, k: int) -> np.ndarray:
        frame = self.content[self.base + int(self.offsets[k]) : self.base + int(self.offsets[k + 1])]
        ids = np.frombuffer(self.box.decompress(frame), f"<u{self.width}")
        if len(ids) != self.counts[k]:
            raise ValueError("a document has another length than its index entry")
        return ids

    def find(self, key: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.keys, key))
        return self.ids(k) if k < len(self.keys) and self.keys[k] == key else None


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    sample_docs: int = 2000,
    sample_chars: int = 20_000,
    cache_bytes: int | None = None,
) -> DataFrame:
    """Write all rows of ``docs``; returns the manifest (file, part, piece, documents, ids), already executed.

    Rows are range-partitioned by key (null keys first, ties by text hash), so files follow the key
    order; a task writes files of about ``FILE_BYTES`` and remembers ``cache_bytes`` of the encoding at most. File names hold a random part: a task that runs
    twice leaves a file that the manifest does not name.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tok = encoder(tokenizer_path)
    width = 2 if tok.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    # The hashes are ranked alone, so that tasks don't send texts which the sample then leaves out.
    short = rows.where(F.length("t") <= sample_chars).select(F.xxhash64("k", "t").alias("h"), "t")
    edge = short.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    some = short.where(F.col("h") <= F.lit(edge)).dropDuplicates(["h"]).orderBy("h").select("t")
    samples = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for x in tok.encode([r["t"] for r in some.collect()])]
    dictionary = train_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, made = TaskContext.get().partitionId(), 0, []
        coder, out = encoder(tokenizer_path, cache_bytes=cache_bytes), TokenFileWriter(dictionary, width)

        def flush() -> None:
            nonlocal out, piece
            if out.keys:
                name = f"part-{part:06d}-{piece:05d}-{uuid.uuid4().hex[:8]}.tok"
                put_file(folder, name, out.to_bytes())
                made.append((name, part, piece, len(out.keys), int(sum(out.counts))))
                out, piece = TokenFileWriter(dictionary, width), piece + 1

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, coder.encode(x.as_py() for x in batch.column(1)), strict=True):
                out.add(k, np.frombuffer(ids + end, "<u4"))
                if out.size >= FILE_BYTES:
                    flush()
        flush()
        names, parts, pieces, counts, totals = zip(*made, strict=True) if made else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in (parts, pieces, counts, totals))], ["file", "part", "piece", "n_docs", "n_ids"])

    sorted_rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    manifest = sorted_rows.select("k", "t").mapInArrow(run, "file string, part long, piece long, n_docs long, n_ids long")
    with small_batches(spark):
        manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files that the manifest names: doc_id, start, n_tokens, ids_crc32, ids."""
    # One row per file of 16 MB: this window is over the manifest, not over documents.
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("file", "before")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(broadcast_if_small(begins), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                book = TokenFile(content.as_py())
                keys, starts, counts, sums, arrays = [], [], [], [], []
                for k in range(len(book)):
                    ids = book.ids(k)
                    keys.append(book.key(k))
                    starts.append(before)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    arrays.append(ids.astype(np.int32))
                    before += len(ids)
                    if len(keys) == 512 or k == len(book) - 1:
                        lengths = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(arrays)))
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                        keys, starts, counts, sums, arrays = [], [], [], [], []

    return files.select("before", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
