import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuemill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return {q: v for q, v in out.items() if v}


def result(spark, rows, k):
    v = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3).select("vec_id", topk.quantise(F.col("embedding")).alias("v"))
    got = topk.top_k(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=k)
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_against_brute_force_with_ties_and_odd_vectors(spark):
    rng = random.Random(6)
    centers = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = [(k, [c + rng.gauss(0, 0.2) for c in centers[k % 5]]) for k in range(900)]
    rows += [(k, rows[7][1]) for k in range(900, 1000)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 10), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1020, None), (1040, [0.0] * 12), (1041, []), (1060, [3.0, -2.0])]
    assert result(spark, rows, 20) == brute(rows, 20)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (20, [2.0, 2.0])]
    assert result(spark, rows, 20) == brute(rows, 20)
    assert result(spark, [(0, [1.0])], 5) == {}


def test_large_values_are_exact(spark):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-3e5, 3e5) for _ in range(6)]) for k in range(60)]
    assert result(spark, rows, 7) == brute(rows, 7)


def test_empty_and_null_ids(spark):
    assert result(spark, [(1, [1.0])], 3) == {}
    v = spark.createDataFrame([(None, [1]), (0, [2]), (3, [4])], "vec_id long, v array<long>")
    q = v.withColumnRenamed("vec_id", "query_id").where("query_id = 0 OR query_id IS NULL")
    assert [tuple(r) for r in topk.top_k(v, q, k=2).collect()] == [(0, 1, 3, 8)]


def test_pruning_skips_blocks():
    rng = np.random.default_rng(2)
    docs = np.concatenate([rng.integers(0, 4, (4000, 16)), rng.integers(50, 60, (256, 16))])
    ids = np.arange(len(docs))
    q = docs[-3:]
    own, order = ids[-3:], topk.order_of_blocks(docs, ids)
    scores, best, scored = topk.search_shard(docs[order], ids[order], q, own, 10)
    exact = q @ docs.T
    for r in range(3):
        exact[r, ids[-3:][r]] = -1
        assert sorted(scores[r], reverse=True) == sorted(exact[r], reverse=True)[:10]
    assert scored.sum() < 3 * len(range(0, len(docs), topk.BLOCK)) / 2


def test_queries_visit_few_shards_and_rounds_give_the_same(spark, monkeypatch):
    for name, value in (("SHARD", 50), ("CHUNK", 7), ("BLOCK", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(3)
    centers = [[rng.gauss(0, 3) for _ in range(12)] for _ in range(8)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in centers[k % 8]]) for k in range(1000)]
    rows += [(k, rows[8][1]) for k in range(1000, 1400)]  # one hot vector
    assert result(spark, rows, 20) == brute(rows, 20)
    v = spark.createDataFrame([(i, [math.floor(64 * x) for x in y]) for i, y in rows], "vec_id long, v array<long>")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = topk.visits(v, q, k=20)
    shards, queries = topk.index_shards(v, v.count()).count(), q.count()
    assert found.count() < 0.6 * shards * queries
    assert found.agg(F.sum("scored")).first()[0] < found.agg(F.sum("blocks")).first()[0]
    monkeypatch.setattr(topk, "BOUNDS", 12 * 2 * 5)
    assert result(spark, rows, 20) == brute(rows, 20)


def test_clashing_extra_columns(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)]
    v = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).select("vec_id", topk.quantise(F.col("embedding")).alias("v"), F.lit("x").alias("shard"), F.lit(1).alias("cell"), F.lit(2).alias("score"))
    got = topk.top_k(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id").withColumn("floor", F.lit("y")), k=4)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found == brute(rows, 4)
