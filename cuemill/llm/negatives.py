"""Hard negatives: norm-bucketed search for the best-scoring candidates inside score windows.

Candidates are integer vectors. They are sorted by descending norm over all tasks and cut into buckets: one row each
of a written table, with its largest norm, ids, labels and vectors in the narrowest integers that hold them. By
Cauchy-Schwarz no score in a bucket exceeds the query's norm times the bucket's largest norm. A bucket is skipped for a
query when that product is below what each of its windows still needs: the window's lower limit, or its k-th score so
far. A bound that equals it is still searched, as a tie may have the smaller id.

Queries are broadcast in chunks of about ``CHUNK``. For a chunk, the buckets of the longest norms (``HEAD`` of them) are
searched first; the k-th scores over all their tasks are limits for the rest, and buckets that no query of the chunk
can use are left out by a filter on the written table. Ranking what all tasks give is the exact result. A task gives at
most k rows for each window, and none below the limits it began with. No candidate is shuffled after the
index is written; a hot norm or vector is split, since rows are dealt by norm, id and row number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import materialize, scratch_path
from cuemill.llm.topk import _matrix, _pad

#: Vectors of a bucket, queries of a chunk (about), queries scored together, buckets searched first.
BUCKET, CHUNK, TOGETHER, HEAD = 1 << 11, 1 << 12, 256, 8
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Norms are doubles; a bound is raised by more than their rounding.
_SLACK = 1 + 1e-9


@dataclass
class Queries:
    """Queries with their windows: (rows x windows) lower and upper limits, both included; lower above upper is a closed window."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lower: np.ndarray
    upper: np.ndarray

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1)) * _SLACK


@dataclass
class Bucket:
    high: float
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << (8 * n - 1)) <= low and high < 1 << (8 * n - 1)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of a x rows of b) as longs; by floating point where that is exact."""
    width = max(a.shape[1], b.shape[1])
    most = float(np.abs(a.astype(float)).max(initial=1)) * float(np.abs(b.astype(float)).max(initial=1)) * max(1, width)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    out = _pad(a, width).astype(kind) @ _pad(b, width).astype(kind).T
    return out if kind == np.int64 else out.astype(np.int64)


class Search:
    """The best ``k`` candidates of each window of each query, over the buckets seen so far."""

    def __init__(self, queries: Queries, k: int, same_label: bool):
        self.q, self.k, self.same = queries, k, same_label
        shape = (*queries.lower.shape, k)
        self.scores, self.found = np.full(shape, LOWEST), np.full(shape, HIGHEST)
        self.used = np.zeros(queries.lower.shape, np.int64)
        self.need = np.where(queries.lower > queries.upper, HIGHEST, queries.lower)
        self.searched = 0

    def live(self, high: float) -> np.ndarray:
        """Queries with a window that a bucket of this largest norm may still serve."""
        need = self.need.min(axis=1, initial=HIGHEST)
        return np.flatnonzero((need < HIGHEST) & (self.q.norms * high * _SLACK >= need))

    def add(self, bucket: Bucket) -> None:
        live = self.live(bucket.high)
        for first in range(0, len(live), TOGETHER):
            own = live[first : first + TOGETHER]
            self.searched += len(own)
            scores = products(self.q.vectors[own], bucket.vectors)
            apart = (self.q.labels[own][:, None] == bucket.labels[None, :]) == self.same
            apart &= self.q.ids[own][:, None] != bucket.ids[None, :]
            for w in range(self.need.shape[1]):
                row, at = np.nonzero(apart & (scores >= self.need[own, w][:, None]) & (scores <= self.q.upper[own, w][:, None]))
                if len(row):
                    self._merge(own, w, row, scores[row, at], bucket.ids[at])

    def _merge(self, own: np.ndarray, w: int, row: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        some = np.unique(row)
        old = own[some]
        kept = np.arange(self.k)[None, :] < self.used[old, w][:, None]
        row = np.concatenate([np.repeat(some, self.used[old, w]), row])
        score, name = np.concatenate([self.scores[old, w][kept], score]), np.concatenate([self.found[old, w][kept], name])
        turn = np.lexsort((name, ~score, row))  # ~ reverses the order of all longs
        row, score, name = row[turn], score[turn], name[turn]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, score, name, place = row[best], score[best], name[best], place[best]
        self.scores[own[row], w, place], self.found[own[row], w, place] = score, name
        self.used[old, w] = np.bincount(row, minlength=some[-1] + 1)[some]
        full = old[self.used[old, w] == self.k]
        self.need[full, w] = np.maximum(self.need[full, w], self.scores[full, w, -1])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, window, score, vec_id) of all that was kept."""
        row, w, place = np.nonzero(np.arange(self.k)[None, None, :] < self.used[:, :, None])
        return self.q.ids[row], w, self.scores[row, w, place], self.found[row, w, place]


# ---------------------------------------------------------------- index


def build_index(vectors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(high, n, width, bytes, ids, labels, vectors): a row for each bucket, written; files by descending norm."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # Written first, so that row numbers are the same whenever a task runs again.
    rows = materialize(vectors.select("vec_id", "label", "v", F.sqrt(square).alias("norm"), F.monotonically_increasing_id().alias("row")), "norms")
    turn = [F.desc("norm"), F.asc("vec_id"), F.asc("row")]
    dealt = rows.repartitionByRange(*turn).sortWithinPartitions(*turn).drop("row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), bucket):
                part = batch.slice(first, bucket)
                x = narrow(_matrix(part.column(2)))
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in (0, 1))
                values = [[part.column(3)[0].as_py()], [len(part)], [x.shape[1]], [x.dtype.itemsize], [ids.tobytes()], [labels.tobytes()], [x.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.float64(), *[pa.int64()] * 3, *[pa.binary()] * 3), strict=True)], _INDEX)

    return materialize(dealt.mapInArrow(pack, "high double, n long, width long, bytes long, ids binary, labels binary, vectors binary"), "buckets")


_INDEX = ["high", "n", "width", "bytes", "ids", "labels", "vectors"]
_FOUND = "query_id long, w int, rank int, vec_id long, score long"


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for k in range(len(batch)):
            high, n, width, size, ids, labels, vectors = (c[k].as_py() for c in batch.columns)
            yield Bucket(high, np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(vectors, f"<i{size}").reshape(n, width))


# ---------------------------------------------------------------- search


def _one_round(index: DataFrame, queries: Queries, k: int, same_label: bool, label: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, k, same_label)
        for b in buckets_of(batches):
            search.add(b)
        found = search.hits()
        for first in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[first : first + (1 << 16)], t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "w", "score", "vec_id"])

    return materialize(index.select(*_INDEX).mapInArrow(run, "query_id long, w int, score long, vec_id long"), label)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The first k of each window, with their rank."""
    turn = F.row_number().over(Window.partitionBy("query_id", "w").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", turn).where(F.col("rank") <= k)


def _limits(some: pa.Table) -> list[np.ndarray]:
    """Lower and upper limits as (rows x windows); windows that a query lacks are closed."""
    out = []
    for name, closed in (("lower", HIGHEST), ("upper", LOWEST)):
        lists = some.column(name).to_pylist()
        out.append(np.array([x + [closed] * (max(map(len, lists)) - len(x)) for x in lists], np.int64))
    return out


def search(index: DataFrame, queries: DataFrame, *, k: int, same_label: bool) -> DataFrame:
    """(query_id, w, rank, vec_id, score): the first k candidates of each window of ``queries``, exactly.

    ``queries`` (query_id, label, v, lower array<long>, upper array<long>) must be written, with one row an id. Candidates
    have the query's label, or another one; the query's own id is never a candidate. Scores must fit a long.
    """
    spark = index.sparkSession
    chunks = -(-queries.count() // CHUNK)
    highs = [r["high"] for r in index.orderBy(F.desc("high")).select("high").limit(HEAD).collect()]
    if not highs or not chunks:
        return spark.createDataFrame([], _FOUND)
    path = scratch_path(spark, "found")
    for c in range(chunks):
        # About CHUNK rows.
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c).orderBy("query_id").toArrow()
        if not some.num_rows:
            continue
        q = Queries(some.column("query_id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v")), *_limits(some))
        head = _one_round(index.where(F.col("high") >= highs[-1]), q, k, same_label, "head")
        # The k-th score so far of each window: at most one row for each window of the chunk.
        for r in ranked(head, k).where(F.col("rank") == k).select("query_id", "w", "score").collect():
            at = np.searchsorted(q.ids, r["query_id"])
            q.lower[at, r["w"]] = max(q.lower[at, r["w"]], r["score"])
        need = np.where(q.lower > q.upper, HIGHEST, q.lower).min(axis=1, initial=HIGHEST)
        # The shortest norm that may still serve a query of this chunk.
        least = (np.maximum(need, 0) / np.maximum(q.norms, 1e-200) / _SLACK**2)[need < HIGHEST].min(initial=np.inf)
        rest = _one_round(index.where((F.col("high") < highs[-1]) & (F.col("high") >= float(least))), q, k, same_label, "rest")
        ranked(head.unionByName(rest), k).select("query_id", "w", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(_FOUND).parquet(path)


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, k: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    ``rows`` and ``anchors`` hold vec_id, label, v (array<long>). An anchor's positives are its best-scoring other rows of
    the same label. A negative has another label and a score of ``low_percent`` to ``high_percent`` of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; higher scores first, ties by
    smaller vec_id; fewer rows where there are fewer. A negative positive score leaves an empty window.

    Rows with a null in any of the three columns take no part. Shorter vectors count as zero beyond their end.
    Repeated rows are candidates each; of anchors with the same id the one with the smallest label, then vector,
    counts; a positive that repeats gives its negatives once. Empty tables give no rows.
    """
    whole = "vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"
    typed = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")]
    index = build_index(rows.where(whole).select(*typed))
    first = anchors.where(whole).select(*typed).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    asked = first.select(F.col("vec_id").alias("query_id"), "a.label", "a.v", F.array(F.lit(int(LOWEST))).alias("lower"), F.array(F.lit(int(HIGHEST))).alias("upper"))
    asked = materialize(asked, "anchors")
    near = search(index, asked, k=positives, same_label=True).select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = near.distinct().withColumn("w", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("positive_score"), "positive_id")) - 1)
    near = materialize(near, "positives")
    # Windows in the order of their positives; ceiling and floor of the percentages in integers that don't overflow.
    hundreds, rest = "(positive_score - pmod(positive_score, 100)) div 100", "pmod(positive_score, 100)"
    lower = F.expr(f"{low_percent} * ({hundreds}) + ({low_percent} * {rest} + 99) div 100").cast("long")
    upper = F.expr(f"{high_percent} * ({hundreds}) + ({high_percent} * {rest}) div 100").cast("long")
    each = near.select("query_id", F.struct("w", lower.alias("lower"), upper.alias("upper")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    windows = materialize(asked.drop("lower", "upper").join(each, "query_id").select("query_id", "label", "v", F.col("x.lower").alias("lower"), F.col("x.upper").alias("upper")), "windows")
    found = search(index, windows, k=k, same_label=False).join(near, ["query_id", "w"])
    return found.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
