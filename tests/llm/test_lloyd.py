import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import lloyd, topk
from cuemill.llm.queries import op12_centroid_clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, width):
    """Rows (id, integers); exact Python integers throughout."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == width and None not in v]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    cents = [list(v) for _, v in first]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(far(v)[1], []).append(v)
        for n, vs in own.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *far(v)[::-1]) for i, v in rows]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    top = lambda x: min(x, lloyd.LARGEST)
    return sorted(((i, n, top(d), top(inertia[n]), top(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in found), key=str)


def result(spark, rows, **options):
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    return sorted((tuple(r) for r in lloyd.cluster(v, **options).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randint(-40, 40) + 60 * (k % 3) for _ in range(5)]) for k in range(400)]
    rows += [(k, rows[3][1]) for k in range(400, 700)]  # one hot vector
    rows += [(3, rows[3][1]), (None, [1, 2, 3, 4, 5]), (900, None), (901, [1, 2]), (902, [1, None, 2, 3, 4]), (903, [])]
    for k, rounds in ((7, 3), (1, 2), (16, 0)):
        assert result(spark, rows, k=k, rounds=rounds, width=5) == brute(rows, k, rounds, 5)


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(k, [2, -3]) for k in range(30)]  # all starts are equal: number 0 takes all, the others stay
    assert result(spark, same, k=4, rounds=3, width=2) == brute(same, 4, 3, 2)
    assert {r[1] for r in result(spark, same, k=4, rounds=3, width=2)} == {0}
    few = [(1, [0, 0]), (2, [5, -1])]
    assert result(spark, few, k=16, rounds=3, width=2) == brute(few, 16, 3, 2)
    assert result(spark, [(1, None)], width=2) == []


def test_floors_of_negative_means_and_large_values(spark):
    rng = random.Random(8)
    small = [(k, [rng.randint(-3, 1)] * 2) for k in range(50)]
    assert result(spark, small, k=3, rounds=3, width=2) == brute(small, 3, 3, 2)
    large = [(k, [rng.choice([-1, 1]) * rng.randint(2**57, 2**62) for _ in range(3)]) for k in range(60)] + [(99, [-(2**63), 2**63 - 1, 0])]
    assert result(spark, large, k=4, rounds=3, width=3) == brute(large, 4, 3, 3)


@pytest.mark.parametrize("scale", [10, 2**40])
def test_distances_are_integers(scale):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-scale, scale, (50, 7)), rng.integers(-scale, scale, (4, 7))
    assert lloyd.squared_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [math.floor(64 * x) for x in r["embedding"]]) for r in given if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    assert sorted((tuple(r) for r in op12_centroid_clustering(spark, sf).collect()), key=str) == brute(rows, 16, 3, 64)


def test_odd_components_and_clashing_columns(spark):
    rows = [(0, [1.5, 2.0], 0), (1, [float("nan"), 1.0], 0), (2, [float("inf"), 1.0], 0), (3, None, None), (4, [None, 1.0], 1), (5, [3e38, -3e38], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", topk.quantise(F.col("embedding"))).withColumns({"cluster": F.lit("x"), "own": F.lit(1), "s": F.lit(2)})
    assert sorted(r["vec_id"] for r in lloyd.cluster(df, k=2, width=2).collect()) == [0, 5]
