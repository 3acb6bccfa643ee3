"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its rows into shards of a few megabytes. A shard's suffix array holds the positions from
which at least the shortest window could be read in words that the benchmark knows at all; positions are
sorted by their next ``window`` words, packed into integers. Every suffix of every benchmark item is then
binary-searched in the array; the matching range gives all places where its window occurs, and
matches that follow each other in both texts are joined to the longest verbatim match. The documents aren't shuffled.

The benchmark is broadcast in blocks of items whose size is checked: a block holds at most
``BLOCK_BYTES`` of text. Blocks are searched one after the other, a pass each, so no process holds two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm._common import batches_of, byte_table, materialize, size_class, without_rows, word_hashes

#: Text of one broadcast block of benchmark items.
BLOCK_BYTES = 8 << 20
#: Words are runs of ASCII letters, digits and non-ASCII characters.
WORDS = byte_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
HITS = "doc_id long, row struct<a:long,b:long>, n_words long, runs array<struct<a:long,b:long>>, items array<string>, longest long, longest_item string, longest_start long"


@dataclass
class Block:
    """Suffixes of some benchmark items: their words as ids, and where items begin."""

    vocabulary: np.ndarray  # sorted word hashes; id 1 is the first
    words: np.ndarray  # ids of all items' words
    begins: np.ndarray  # first word of each item, one more entry at the end
    names: list[str]
    window: int

    @classmethod
    def of(cls, names: list[str], texts: list[str], window: int) -> Block:
        raw = [x.encode() for x in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        hashes, begins = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, WORDS)
        vocabulary, ids = np.unique(hashes, return_inverse=True)
        return cls(vocabulary, ids.astype(np.int64) + 1, begins, names, window)

    def suffixes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, first words, items) for each length that occurs."""
        sizes = np.diff(self.begins)
        for length in np.unique(np.minimum(sizes[sizes > 0], self.window)):
            own = np.flatnonzero((sizes >= self.window) if length == self.window else (sizes == length))
            firsts = [np.arange(self.begins[k], self.begins[k] + sizes[k] - length + 1) for k in own]
            yield int(length), np.concatenate(firsts), np.repeat(own, [len(x) for x in firsts])


def _keys(ids: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The ``length`` words from each position as rows of packed integers, most significant first."""
    per = max(1, 63 // bits)
    columns = []
    for k in range(0, length, per):
        packed = np.zeros(len(at), np.int64)
        for j in range(k, min(length, k + per)):
            packed = (packed << bits) | ids[at + j]
        columns.append(packed)
    return np.stack(columns, axis=1)


def suffix_array(ids: np.ndarray, at: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of their next ``length`` words, with those words' packed integers."""
    keys = _keys(ids, at, length, bits)
    order = np.lexsort(keys.T[::-1])
    return at[order], keys[order]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: for each wanted row, the range of equal rows in the sorted ``keys``."""
    lo = np.searchsorted(keys[:, 0], wanted[:, 0], side="left")
    hi = np.searchsorted(keys[:, 0], wanted[:, 0], side="right")
    for c in range(1, keys.shape[1]):
        for k in np.flatnonzero(hi > lo):
            part = keys[lo[k] : hi[k], c]
            lo[k], hi[k] = lo[k] + np.searchsorted(part, wanted[k, c], side="left"), lo[k] + np.searchsorted(part, wanted[k, c], side="right")
    return lo, hi


class Shard:
    """What blocks of the benchmark hit in the documents of one shard."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray):
        self.hashes, self.firsts = hashes, firsts
        self.hit = np.zeros(len(hashes) + 1, np.int32)
        self.pairs: dict[int, set[str]] = {}
        self.longest: dict[int, tuple[int, str, int]] = {}

    def search(self, block: Block) -> None:
        if not len(block.vocabulary) or not len(self.hashes):
            return
        spot = np.minimum(np.searchsorted(block.vocabulary, self.hashes), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[spot] == self.hashes, spot + 1, 0).astype(np.int64)
        room = _run_lengths(ids, self.firsts)
        bits = max(1, int(len(block.vocabulary)).bit_length())
        for length, firsts, items in block.suffixes():
            at = np.flatnonzero(room >= length)
            if not len(at):
                continue
            places, keys = suffix_array(ids, at, length, bits)
            lo, hi = find(keys, _keys(block.words, firsts, length, bits))
            self._mark(block, places, lo, hi, firsts, items, length)

    def _mark(self, block: Block, places: np.ndarray, lo: np.ndarray, hi: np.ndarray, firsts: np.ndarray, items: np.ndarray, length: int) -> None:
        counts = hi - lo
        if not counts.any():
            return
        # All matches: the k-th suffix with each of its places.
        own = np.repeat(np.arange(len(counts)), counts)
        place = places[np.repeat(lo - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(len(own))]
        once = np.unique(place)
        np.add.at(self.hit, once, 1)
        np.subtract.at(self.hit, once + length, 1)
        doc, first, item = np.searchsorted(self.firsts, place, side="right") - 1, firsts[own], items[own]
        for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
            self.pairs.setdefault(d, set()).add(block.names[i])
        # Matches of one item that follow each other in both texts are one longer match.
        turn = np.lexsort((place, place - first, item, doc))
        doc, item, place, first = doc[turn], item[turn], place[turn], first[turn]
        begins = np.ones(len(turn), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (first[1:] != first[:-1] + 1)
        begins = np.flatnonzero(begins)
        sizes = np.diff(np.r_[begins, len(turn)]) - 1 + length
        starts = place[begins] - self.firsts[doc[begins]]
        for d, i, size, start in zip(doc[begins].tolist(), item[begins].tolist(), sizes.tolist(), starts.tolist(), strict=True):
            best = (-size, block.names[i], start)
            if d not in self.longest or best < self.longest[d]:
                self.longest[d] = best

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one hit words of each run within a document."""
        hit = np.cumsum(self.hit[:-1]) > 0
        edge = np.zeros(len(hit) + 1, bool)
        edge[self.firsts] = True
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | edge[1:-1]
        end = hit.copy()
        end[:-1] &= ~hit[1:] | edge[1:-1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _run_lengths(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Known words in a row from each position, not past the end of its document."""
    n = len(ids)
    stops = np.unique(np.concatenate([np.flatnonzero(ids == 0), firsts[1:], [n]]))
    where = np.arange(n)
    # A document's first word stops the run of the document before it, not its own.
    return np.where(ids == 0, 0, stops[np.searchsorted(stops, where, side="right")] - where)


def _blocks(benchmark: DataFrame, window: int, item: str, text: str) -> Iterator[tuple[Broadcast, bool]]:
    """(broadcast block of items, whether it is the last), one after the other; only the last stays broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    _, size = size_class(items, "t")
    count = max(1, -(-size // BLOCK_BYTES))
    if count > 1:
        items = materialize(items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(count)).cast("int")), "blocks")
    for k in range(count):
        rows = (items if count == 1 else items.where(F.col("k") == k)).collect()  # at most about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(Block.of([r["i"] for r in rows], [r["t"] for r in rows], window))
        yield shared, k + 1 == count
        shared.unpersist()  # not reached after the last block, which a lazy result still needs


def _hits(docs: DataFrame, block: Broadcast) -> DataFrame:
    """(doc_id, text key, n_words, hit ranges, items, longest match) of every row of ``docs`` (doc_id, t, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches_of(batches, "t"):
            shard = Shard(*word_hashes(data, offsets, WORDS))
            shard.search(block.value)
            n = len(batch)
            begins, ends = shard.ranges()
            cuts = np.searchsorted(begins, shard.firsts).astype(np.int32)
            owner = shard.firsts[np.searchsorted(shard.firsts, begins, side="right") - 1]
            runs = pa.StructArray.from_arrays([pa.array(begins - owner, pa.int64()), pa.array(ends - owner, pa.int64())], ["a", "b"])
            best = [shard.longest.get(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(shard.firsts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), runs),
                    pa.array([sorted(shard.pairs.get(k, ())) for k in range(n)], pa.list_(pa.string())),
                    pa.array([-b[0] if b else 0 for b in best], pa.int64()),
                    pa.array([b[1] if b else None for b in best], pa.string()),
                    pa.array([b[2] if b else None for b in best], pa.int64()),
                ],
                ["doc_id", "row", "n_words", "runs", "items", "longest", "longest_item", "longest_start"],
            )

    return docs.select("doc_id", "row", "t").mapInArrow(run, HITS)


def match_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, hit words, items found, and the longest verbatim match.

    A document's word is hit if it lies in an occurrence of ``window`` consecutive words of an item (of all
    its words, if it has fewer). Null texts have no words; an empty benchmark hits nothing; repeated rows
    count each on its own; items with equal text are all found; items with a null id are left out.
    ``longest_start`` is the match's first word in the document, from 0.

    A benchmark of one block is one pass. A larger one takes a pass for each block, so that no task and no
    driver holds more than a block; the hits of each pass are written and united by row.
    """
    row = F.struct(F.xxhash64(key, text).alias("a"), F.xxhash64(F.lit(1), text, key).alias("b"))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.lit(None).cast("struct<a:long,b:long>").alias("row"), F.col(text).alias("t"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row.alias("row"), F.col(text).alias("t"))
    parts = []
    for block, last in _blocks(benchmark, window, item, item_text):
        found = _hits(plain if last and not parts else rows, block)
        if last and not parts:
            total = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
            return found.select("doc_id", "n_words", total.alias("n_hit"), "items", "longest", "longest_item", "longest_start")
        parts.append(materialize(found if not parts else found.where("size(items) > 0"), f"hits-{len(parts)}"))
    first, rest = parts[0], parts[1:]
    hits = first.where("size(items) > 0")
    for part in rest:
        hits = hits.unionByName(part)
    best = F.min(F.struct((-F.col("longest")).alias("n"), "longest_item", "longest_start"))
    whole = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), best.alias("best"))
    # Runs in order of their begin: each adds what lies beyond the last end.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    more = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    whole = whole.select("row", F.aggregate("runs", start, more, lambda s: s["n"]).alias("n_hit"), F.col("items"), (-F.col("best.n")).alias("longest"), "best.longest_item", "best.longest_start")
    out = first.select("doc_id", "row", "n_words").join(whole, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest"), "longest_item", "longest_start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; same columns.

    Each row is judged by its own text in the pass that searches it, so nothing is shuffled and null or
    repeated keys don't matter. Null texts stay. Each block of the benchmark is one pass.
    """

    def without(rows: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in batches_of(batches, text):
                shard = Shard(*word_hashes(data, offsets, WORDS))
                shard.search(block.value)
                gone = np.zeros(len(batch), bool)
                gone[list(shard.pairs)] = True
                yield without_rows(batch, gone)

        return rows.mapInArrow(run, docs.schema)

    for block, last in _blocks(benchmark, window, item, item_text):
        docs = without(docs, block)
        if last:
            break
        docs = materialize(docs, "decontaminated")
    return docs
