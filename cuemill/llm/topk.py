"""Exact top-k inner-product search with block-at-a-time pruning.

Documents are integer vectors; a vector's components are its terms. Vectors that are near the same pivot
(one of a bounded sample) go to the same shard; a large cell is dealt by hash to several shards, so a
shard's size is bounded. A shard is written as one row: its vectors in an order of neighbours (the forward
index, cut into blocks) and the largest and smallest value of each term. For a query the sum over terms of
the larger product of its weight with those two bounds every score in the shard, or in a block.

Search takes two passes. First each query goes to the one shard with the highest bound; its k-th score there
is a threshold. Then it goes only to those other shards whose bounds reach the threshold. Within a shard, blocks are
visited by descending bound and scored through the forward index until the next bound is below the k-th score
or the threshold; a bound that equals it is still scored, since a tie may have the smaller id. A ranking over
what all shards give is the result, which is exact.

Bounds are broadcast in rounds of ``BOUNDS`` numbers; one Spark group is one shard with at most about ``CHUNK`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import materialize

#: Vectors of a shard and queries of a chunk at most (about), and vectors of a block.
SHARD, CHUNK, BLOCK = 1 << 13, 1 << 12, 128
#: Pivots that deal vectors to shards at most, and numbers of the bounds that are broadcast together.
PIVOTS, BOUNDS = 1024, 1 << 22
_NONE = np.iinfo(np.int64).min


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as longs; null if the vector is null or has a null or non-finite one."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Arrays as rows, with zeros beyond their ends up to the longest one or ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = 0
    for k, n in enumerate(sizes):
        out[k, :n] = flat[at : at + n]
        at += n
    return out


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _pad(x, width).astype(float), _pad(pivots, width).astype(float)
    return np.argmax(x @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1)


def order_of_blocks(docs: np.ndarray, ids: np.ndarray, pivots: int = 32) -> np.ndarray:
    """Documents by their nearest of a few pivots, then id: neighbours share blocks, so bounds are tight."""
    if len(docs) <= BLOCK:
        return np.argsort(ids, kind="stable")
    some = docs[np.argsort(ids, kind="stable")[:: max(1, len(docs) // pivots)][:pivots]]
    return np.lexsort((ids, _nearest(docs, some)))


def search_shard(docs: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of one shard, none below a query's floor: scores and ids (queries x k; unused places hold ``_NONE``), and blocks scored of each query.

    ``docs`` are in their order of blocks.
    """
    width = max(docs.shape[1], queries.shape[1])
    docs, queries = _pad(docs, width), _pad(queries, width)
    most = float(max(1, np.abs(docs).max(initial=0))) * float(max(1, np.abs(queries).max(initial=0))) * max(1, width)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    d, q = docs.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(docs), BLOCK)
    high, low = np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    scores = np.full((len(q), k), _NONE, np.int64)
    best = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    least = np.full(len(q), _NONE, np.int64) if floors is None else floors.copy()
    scored = np.zeros(len(q), np.int64)
    for r in range(len(starts)):
        block = visit[:, r]
        bound = np.take_along_axis(bounds, block[:, None], axis=1)[:, 0]
        live = np.flatnonzero((least == _NONE) | (bound >= least))
        if not len(live):
            break
        for b in np.unique(block[live]):
            own = live[block[live] == b]
            part = slice(starts[b], min(starts[b] + BLOCK, len(docs)))
            got = np.rint(q[own] @ d[part].T).astype(np.int64) if kind != np.int64 else q[own] @ d[part].T
            got[query_ids[own][:, None] == ids[part][None, :]] = _NONE
            scored[own] += 1
            got[got < least[own][:, None]] = _NONE
            rows = np.flatnonzero((got != _NONE).any(axis=1))
            if not len(rows):
                continue
            both = np.concatenate([scores[own[rows]], got[rows]], axis=1)
            names = np.concatenate([best[own[rows]], np.broadcast_to(ids[part], (len(rows), len(ids[part])))], axis=1)
            top = np.lexsort((names, -both.astype(np.float64) if most < 1 << 53 else np.where(both == _NONE, np.iinfo(np.int64).max, -both)), axis=1)[:, :k]
            scores[own[rows]] = np.take_along_axis(both, top, axis=1)
            best[own[rows]] = np.take_along_axis(names, top, axis=1)
            least[own[rows]] = np.maximum(least[own[rows]], scores[own[rows], -1])
    return scores, best, scored


def index_shards(docs: DataFrame, total: int) -> DataFrame:
    """(shard, n, width, ids, vectors, high, low): one row a shard, written; ids and vectors are little-endian longs in order of blocks."""
    count = min(PIVOTS, max(1, total // SHARD))
    # At most PIVOTS vectors, the first by hash.
    pivots = docs.select("v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(count).toArrow()
    pivots = docs.sparkSession.sparkContext.broadcast(_matrix(pivots.column("v")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _nearest(_matrix(batch.column(1)), pivots.value) if len(batch) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], ["vec_id", "v", "cell"])

    dealt = materialize(docs.select("vec_id", "v").mapInArrow(near, "vec_id long, v array<long>, cell long"), "cells")
    # One row for each pivot.
    cells = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).alias("parts"))
    cells = cells.withColumn("first", F.coalesce(F.sum("parts").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.join(F.broadcast(cells), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))

    def pack(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t.column("v")), t.column("vec_id").to_numpy()
        turn = order_of_blocks(x, ids)
        x, ids = x[turn].astype("<i8"), ids[turn].astype("<i8")
        sides = [pa.array([y.tolist()], pa.list_(pa.int64())) for y in (x.max(axis=0), x.min(axis=0))]
        return pa.table([t.column("shard").slice(0, 1), [len(ids)], [x.shape[1]], [ids.tobytes()], [x.tobytes()], *sides], names=["shard", "n", "width", "ids", "vectors", "high", "low"])

    packed = dealt.select("shard", "vec_id", "v").groupBy("shard").applyInArrow(pack, "shard long, n long, width long, ids binary, vectors binary, high array<long>, low array<long>")
    return materialize(packed, "shards")


def _rounds(index: DataFrame, width: int) -> Iterator[DataFrame]:
    """The bounds of all shards, at most about ``BOUNDS`` numbers at once."""
    shards = index.count()
    rounds = max(1, -(-shards * 2 * max(1, width) // BOUNDS))
    for k in range(rounds):
        yield index.select("shard", "high", "low").where(F.pmod("shard", F.lit(rounds)) == k)


def reached(queries: DataFrame, bounds: DataFrame, best: bool) -> DataFrame:
    """``queries`` (query_id, v, floor, skip) with a shard each: the one with the highest bound, or all but ``skip`` whose bound reaches the floor."""
    some = bounds.orderBy("shard").toArrow()  # at most about BOUNDS numbers
    shards = some.column("shard").to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((shards, _matrix(some.column("high")), _matrix(some.column("low"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, high, low = shared.value
        for whole in batches:
            for first in range(0, len(whole), 512):
                batch = whole.slice(first, 512)
                if not len(shards):
                    continue
                q = _matrix(batch.column(1), high.shape[1])
                h, m = _pad(high, q.shape[1]), _pad(low, q.shape[1])
                # Exact below 2 ** 53; beyond, a little too high is still a bound.
                most = float(max(1, np.abs(q).max())) * float(max(1, np.abs(h).max(), np.abs(m).max())) * q.shape[1]
                x = q.astype(float)
                limit = np.maximum(x, 0) @ h.astype(float).T + np.minimum(x, 0) @ m.astype(float).T + (most * 1e-14 if most >= 1 << 53 else 0)
                if best:
                    row, at = np.arange(len(q)), limit.argmax(axis=1)
                else:
                    floor, skip = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                    row, at = np.nonzero((limit >= floor[:, None]) & (shards[None, :] != skip[:, None]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[:3]), pa.array(shards[at], pa.int64())], ["query_id", "v", "floor", "shard"])

    return queries.select("query_id", "v", "floor", "skip").mapInArrow(run, "query_id long, v array<long>, floor long, shard long")


def search(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, shard, blocks, scored, hits (vec_id, score)) of ``asked`` (query_id, v, floor, shard): one row each."""
    asked = materialize(asked, "asked")
    chunks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("chunks"))
    left = asked.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).drop("chunks")
    right = index.select("shard", "width", "ids", "vectors").join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    hit = pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])
    out = pa.schema([("query_id", pa.int64()), ("shard", pa.int64()), ("blocks", pa.int64()), ("scored", pa.int64()), ("hits", pa.list_(hit))])

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not d.num_rows or not q.num_rows:
            return out.empty_table()
        ids = np.frombuffer(d.column("ids")[0].as_py(), "<i8")
        docs = np.frombuffer(d.column("vectors")[0].as_py(), "<i8").reshape(len(ids), d.column("width")[0].as_py())
        query_ids = q.column("query_id").to_numpy()
        scores, names, scored = search_shard(docs, ids, _matrix(q.column("v")), query_ids, k, q.column("floor").to_numpy())
        real = scores != _NONE
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(real.sum(axis=1))], pa.int32()), pa.StructArray.from_arrays([pa.array(names[real]), pa.array(scores[real])], ["vec_id", "score"]))
        blocks = np.full(len(query_ids), -(-len(ids) // BLOCK))
        return pa.table([query_ids, q.column("shard"), blocks, scored, lists], schema=out)

    return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(run, "query_id long, shard long, blocks long, scored long, hits array<struct<vec_id:long,score:long>>")


def visits(docs: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """What ``search`` gives for both passes; what is missing here was skipped as a whole."""
    docs = docs.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    queries = queries.where("query_id IS NOT NULL AND v IS NOT NULL").groupBy("query_id").agg(F.min("v").alias("v"))
    index = index_shards(docs, docs.count())
    width = index.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
    rounds = list(_rounds(index, width))
    none = F.lit(_NONE)
    queries = materialize(queries, "queries")
    first = materialize(search(reached(queries.withColumns({"floor": none, "skip": none}), rounds[0], True), index, k), "first-pass")
    floors = first.select(F.col("query_id"), F.col("shard").alias("skip"), F.when(F.size("hits") >= k, F.element_at("hits", -1)["score"]).otherwise(none).alias("floor"))
    queries = materialize(queries.join(floors, "query_id"), "floors")
    out = first
    for bounds in rounds:
        out = out.unionByName(materialize(search(reached(queries, bounds, False), index, k), "second-pass"))
    return out


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """The k highest inner products of each query with all documents but those of its own id.

    ``docs`` (vec_id, v) and ``queries`` (query_id, v) hold arrays of longs. Returns query_id, rank, vec_id,
    score; ties go to the smaller vec_id; fewer rows where there are fewer candidates. Rows with a null id
    or vector take no part. Shorter vectors count as zero beyond their end. Repeated documents are
    candidates each on its own; of repeated query ids the smallest vector is the query.
    """
    found = visits(docs, queries, k=k).select("query_id", F.inline("hits"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
