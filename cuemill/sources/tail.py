"""The newest entries of JSON-line logs, read from the ends of the files.

A Python data source, ``json_tail``: a task for each file reads blocks backwards until it has enough lines that are JSON
objects, so a long log costs what was asked for. Blank and malformed lines are skipped. Files are opened through Arrow's
file systems, so they may lie in any store that these know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuemill.sources.files import parse_jobs

BLOCK = 1 << 16


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def lines_from_the_end(store: pafs.FileSystem, path: str, block: int = BLOCK) -> Iterator[tuple[int, bytes, int]]:
    """(byte offset, line, bytes read so far) of a file's lines, the last one first."""
    with store.open_input_file(path) as f:
        at, rest, seen = f.size(), [], 0
        while at > 0:
            size = min(block, at)
            at -= size
            f.seek(at)
            piece = f.read(size)
            seen += size
            head, *lines = piece.split(b"\n")
            if lines:
                # The last part of this block begins the line whose end was read before.
                lines[-1] += b"".join(reversed(rest))
                rest, end = [], at + len(head) + 1 + sum(len(x) + 1 for x in lines)
                for line in reversed(lines):
                    end -= len(line) + 1
                    yield end, line, seen
            rest.append(head)
        yield 0, b"".join(reversed(rest)), seen


def _is_object(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


@dataclass
class _File(InputPartition):
    path: str


class _TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.block = options["path"], int(options.get("limit", 200)), int(options.get("block", BLOCK))
        self.scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            return []
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path))
        return [_File(x.path) for x in files if x.is_file and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File | None) -> Iterator[tuple[str, int, str, int]]:
        if partition is None or self.limit < 1:
            return
        store, _ = _store(self.path)
        found = 0
        for at, line, seen in lines_from_the_end(store, partition.path, self.block):
            if line.strip() and _is_object(line):
                found += 1
                yield partition.path, at, line.decode("utf-8", errors="replace").strip(), seen
                if found == self.limit:
                    return


class JsonTail(DataSource):
    """Options: ``path`` (a file or a folder), ``limit`` (entries of each file at most), ``block`` (bytes read at once)."""

    @classmethod
    def name(cls) -> str:
        return "json_tail"

    def schema(self) -> str:
        return "file string, at long, value string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


def tail(spark: SparkSession, path: str, *, limit: int = 200, block: int = BLOCK) -> DataFrame:
    """(file, at, value, bytes_read): the last ``limit`` JSON objects of each file, with their byte offsets."""
    spark.dataSource.register(JsonTail)
    return spark.read.format("json_tail").option("path", path).option("limit", limit).option("block", block).load()


def recent(spark: SparkSession, path: str, schema: str, *, limit: int = 200) -> DataFrame:
    """The newest ``limit`` entries of a log, newest first: a later file name is newer, and within a file what stands later."""
    last = tail(spark, path, limit=limit).orderBy(F.desc("file"), F.desc("at")).limit(max(0, limit))
    return parse_jobs(last.select("file", "at", "value"), schema, "value").orderBy(F.desc("file"), F.desc("at"))
