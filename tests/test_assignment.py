import random

from cuemill.operators import folds


def brute(rows):
    best = {}
    for g, a, b, s in rows:
        if None not in (a, b, s):
            best[g, a, b] = max(s, best.get((g, a, b), s))
    left, right, out = set(), set(), []
    for (g, a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.append((g, a, b, s))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "grp long, a long, b long, score double").repartition(3)
    return sorted((tuple(r) for r in folds.greedy_pairs(df).collect()), key=str)


def test_against_the_sequential_order(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(12), rng.randrange(9), rng.choice([0.25, 0.5, 0.75, rng.random()])) for g in (0, 1, 2, None) for _ in range(70)]
    rows += [(3, 1, 1, 0.5), (3, 1, 1, 0.9), (3, None, 1, 1.0), (3, 2, None, 1.0), (3, 2, 1, None)]
    assert result(spark, rows) == brute(rows)


def test_a_chain_takes_a_round_for_each_pair(spark):
    # Each pair is only free to be the best once the one before has been taken.
    rows = [(0, k, k, 10.0 - 2 * k) for k in range(5)] + [(0, k + 1, k, 9.5 - 2 * k) for k in range(5)]
    assert result(spark, rows) == brute(rows) and len(result(spark, rows)) == 5


def test_strongest_pairing_is_fixed_first(spark):
    # One profile suits three clusters: only the strongest gets it, the others their next best or nothing.
    rows = [(0, 1, 7, 0.9), (0, 2, 7, 0.95), (0, 3, 7, 0.9), (0, 1, 8, 0.6), (0, 3, 8, 0.6)]
    assert result(spark, rows) == [(0, 1, 8, 0.6), (0, 2, 7, 0.95)]
    assert result(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.5)], "grp long, a long, b long, score double")
    plan = folds.greedy_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
