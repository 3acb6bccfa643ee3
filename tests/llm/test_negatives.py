import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import negatives
from cuemill.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, label int, v array<long>"


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute(rows, every=10, positives=5, k=10, low=30, high=90):
    rows = [r for r in rows if None not in r]
    out, anchors = [], {}
    for i, label, v in sorted(rows):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    for a, (label, v) in anchors.items():
        scores = [(-dot(v, w), i, m) for i, m, w in rows if i != a]
        for p, score in dict.fromkeys((i, -s) for s, i, m in sorted(x for x in scores if x[2] == label)[:positives]):
            fits = sorted((s, i) for s, i, m in scores if m != label and low * score <= -100 * s <= high * score)[:k]
            out += [(a, p, n + 1, i, score, -s) for n, (s, i) in enumerate(fits)]
    return sorted(out)


def result(spark, rows, every=10, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in negatives.mine(df, df.where(F.col("vec_id") % every == 0), **options).collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BUCKET", 16), ("CHUNK", 9), ("TOGETHER", 4), ("HEAD", 2)):
        monkeypatch.setattr(negatives, name, value)
    build = negatives.build_index
    monkeypatch.setattr(negatives, "build_index", lambda v: build(v, 16))


def test_against_brute_force_in_small_buckets_and_chunks(spark, small):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 2), [rng.randint(-9, 9) * (1 + k % 5) for _ in range(4)]) for k in range(300)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, positives=2, k=3, low_percent=50, high_percent=100) == brute(rows, positives=2, k=3, low=50, high=100)


def test_hot_vector_ties_repeated_rows_and_nulls(spark, small):
    rng = random.Random(3)
    rows = [(k, k % 3, [rng.randint(-3, 3) for _ in range(3)]) for k in range(120)]
    rows += [(k, 0, [2, 2, 1]) for k in range(200, 320)] + [(k, 1, [1, 1, 1]) for k in range(320, 400)]
    rows += [rows[7]] * 4 + [(200, 0, [2, 2, 1]), (None, 1, [1, 1, 1]), (500, None, [1, 1, 1]), (510, 1, None), (520, 1, []), (530, 2, [0, 0, 0]), (540, 1, [4])]
    assert result(spark, rows) == brute(rows)


def test_negative_scores_and_few_rows(spark):
    # All positives score below zero: their windows are empty; a score of zero admits only zero.
    assert result(spark, [(0, 1, [1, 0]), (1, 1, [-5, 0]), (2, 2, [-2, 0])]) == []
    assert result(spark, [(0, 1, [1, 0]), (1, 1, [0, 3]), (2, 2, [0, 1]), (3, 2, [1, 1])]) == [(0, 1, 1, 2, 0, 0)]
    assert result(spark, [(0, 1, [1])]) == [] and result(spark, [(1, 1, [1])]) == []
    assert result(spark, [(None, None, None)]) == []


def test_large_values_are_exact(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [rng.randint(-(2**28), 2**28) for _ in range(3)]) for k in range(80)]
    assert result(spark, rows) == brute(rows)


def test_buckets_below_the_windows_are_skipped():
    rng = np.random.default_rng(4)
    sets = [rng.integers(-10 * 2**k, 10 * 2**k, (50, 8)) for k in reversed(range(8))]
    buckets = [negatives.Bucket(float(np.sqrt((x**2).sum(axis=1)).max()), np.arange(50) + 50 * n, np.zeros(50, int), x) for n, x in enumerate(sets)]
    q = sets[0][:3]
    every = np.concatenate(sets) @ q.T
    for lower, most in ((np.sort(every, axis=0)[-1] // 2, 3 * 4), (np.full(3, -(2**60)), 3 * 7)):
        found = negatives.Search(negatives.Queries(np.array([-1, -2, -3]), np.ones(3, int), q, lower[:, None], np.full((3, 1), 2**60)), 4, False)
        for b in buckets:
            found.add(b)
        ids, _, scores, names = found.hits()
        for n in range(3):
            want = sorted(((-s, i) for i, s in enumerate(every[:, n]) if s >= lower[n]))[:4]
            assert sorted((-s, i) for s, i in zip(scores[ids == -1 - n], names[ids == -1 - n], strict=True)) == want
        assert found.searched <= most


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], np.floor(256 * np.array(r["embedding"])).astype(int).tolist()) for r in given if r["label"] is not None and r["embedding"] is not None and np.isfinite(np.array(r["embedding"], float)).all()]
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, sf).collect()) == brute(rows, 100)


def test_narrow_integers_and_clashing_columns(spark):
    for value, size in ((127, 1), (-128, 1), (128, 2), (2**31, 8), (-(2**31), 4)):
        assert negatives.narrow(np.array([[value, 0]])).dtype.itemsize == size
    df = spark.createDataFrame([(k, k % 2, [k, 1]) for k in range(40)], SCHEMA).withColumns({"score": F.lit("x"), "norm": F.lit(1), "rank": F.lit(2), "w": F.lit(3)})
    got = sorted(tuple(r) for r in negatives.mine(df, df.where("vec_id % 10 = 0")).collect())
    assert got == brute([(k, k % 2, [k, 1]) for k in range(40)])
