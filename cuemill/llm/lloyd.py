"""Centroid clustering: plain Lloyd iterations in exact integers.

Vectors are arrays of longs, written once. The centroids (``k`` rows of one width, so their size is bounded) are
broadcast. In each round tasks compare their vectors with each centroid by integer squared differences; the lowest
number wins ties. Each task gives one row per centroid with integer sums, which a groupBy merges, and the new
centroid is the floor of sum / count. Nothing but centroids and their sums comes to the driver.

Defined results: rows with a null vector, a null component or another width than ``width`` take no part; a row with a
null id can't be a start but is clustered; repeated rows count each; an empty table gives no rows; with fewer vectors
than ``k`` there are fewer centroids. An empty cluster keeps its centroid. Distances and sums beyond a long are given
as the largest long; what cluster a vector belongs to is exact at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import materialize

LARGEST = (1 << 63) - 1
#: Vectors that a task compares together: their differences from one centroid are its largest array.
TOGETHER = 4096
_EXACT = "decimal(38,0)"


def starts(vectors: DataFrame, k: int, salt: str = "1") -> np.ndarray:
    """The ``k`` vectors with the smallest lower-case hex sha256 of ``<salt>:<vec_id>``, in that order, as rows."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").orderBy(digest, "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in first], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Integer squared distances (rows x centroids); Python integers where a long might not hold them."""
    most = max(int(np.abs(a.astype(object) if a.size and a.min() == np.iinfo(np.int64).min else a).max()) if a.size else 0 for a in (x, centroids))
    kind = np.int64 if 4 * most * most * max(1, x.shape[1]) <= LARGEST else object
    out = np.empty((len(x), len(centroids)), kind)
    wide = x.astype(kind)
    for c, centroid in enumerate(centroids.astype(kind)):
        apart = wide - centroid
        out[:, c] = np.einsum("ij,ij->i", apart, apart) if kind == np.int64 else (apart * apart).sum(axis=1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lowest number on ties, and its squared distance."""
    far = squared_distances(x, centroids)
    at = np.array([min(range(len(row)), key=row.__getitem__) for row in far], np.int64) if far.dtype == object else far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for first in range(0, len(frame), TOGETHER):
            part = frame.iloc[first : first + TOGETHER]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64, copy=False)


def sums(vectors: DataFrame, centroids: Broadcast) -> DataFrame:
    """(cluster, n, s): exact counts and component sums of each centroid's vectors."""
    width = centroids.value.shape[1]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = centroids.value
        count, total = np.zeros(len(own), np.int64), np.zeros((len(own), width), object)
        for _, x in _blocks(frames):
            at, _ = nearest(x, own)
            wide = x if np.abs(x.astype(float)).max(initial=0) * len(x) < 2**62 else x.astype(object)
            for c in np.unique(at):
                rows = wide[at == c]
                count[c] += len(rows)
                total[c] += rows.sum(axis=0)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some, "n": count[some], "s": [[Decimal(int(y)) for y in total[c]] for c in some]})

    parts = vectors.select("v").mapInPandas(each, f"cluster long, n long, s array<{_EXACT}>")
    merged = [F.sum(F.get("s", F.lit(i))).cast(_EXACT) for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*merged).alias("s"))


def assign(vectors: DataFrame, centroids: Broadcast) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _blocks(frames):
            at, far = nearest(x, centroids.value)
            far = np.array([min(int(d), LARGEST) for d in far], np.int64) if far.dtype == object else far
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at, "distance": far})

    return vectors.select("vec_id", "v").mapInPandas(each, "vec_id long, cluster int, distance long")


def moved(centroids: np.ndarray, found: DataFrame) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component where a centroid has vectors."""
    out = centroids.copy()
    for r in found.collect():  # at most one row for each centroid
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def _long(total: Column) -> Column:
    return F.least(total, F.lit(Decimal(LARGEST)).cast(_EXACT)).cast("long")


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, width: int = 64, salt: str = "1") -> DataFrame:
    """Clusters of ``vectors`` (vec_id, v array<long>) after ``rounds`` rounds and one more assignment.

    Returns vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over
    all), centroid_sha256 (of the final centroid's components in decimal, joined by commas).
    """
    spark = vectors.sparkSession
    whole = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull())
    vectors = materialize(vectors.where(F.col("v").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")), "vectors")
    centroids = starts(vectors, k, salt)
    if not len(centroids):
        return vectors.limit(0).select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(centroids, sums(vectors, spark.sparkContext.broadcast(centroids)))
    found = materialize(assign(vectors, spark.sparkContext.broadcast(centroids)), "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast(_EXACT)).cast(_EXACT).alias("own"))  # a row for each centroid
    each = each.withColumn("all", F.sum("own").over(Window.partitionBy(F.lit(0))).cast(_EXACT)).select("cluster", _long(F.col("own")).alias("cluster_inertia"), _long(F.col("all")).alias("inertia"))
    each = each.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
