import difflib
import random
import re

from cuemill.operators import titles

SCHEMA = "id int, title string, seconds double"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def normal(t):
    return " ".join(re.sub(r"[^\w\s]|_", " ", (t or "").lower()).split())


def brute(rows, percent=60, tolerance=5.0):
    out = {}
    for i, t, s in rows:
        scores = [ratio(normal(t), normal(u)) for j, u, r in rows if j != i and normal(t) and normal(u) and (s is None or r is None or abs(s - r) <= tolerance)]
        best = max((x for x in scores if x >= percent / 100), default=None)
        out[i] = (best, "clear" if best is None else "likely_duplicate" if best >= 0.85 else "possible")
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    some = [words(rng, rng.randint(1, 4)) for _ in range(40)]
    some += [t[: rng.randint(0, len(t))] + rng.choice(["", "x", " no 2"]) + t[rng.randint(0, len(t)) :] for t in some] + ["", "a", "aa", "𝄞𝄞 x", "𝄞 x"]
    df = spark.createDataFrame([(t,) for t in [*some, None, *some[:5]]], "title string").repartition(3)
    for percent in (60, 85):
        got = {(r["a"], r["b"]): r["ratio"] for r in titles.similar_titles(df, percent=percent).collect()}
        assert got == {(a, b): ratio(a, b) for a in set(some) for b in set(some) if a != b and a and b and ratio(a, b) >= percent / 100}


def test_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    pool = [words(rng, 2) for _ in range(12)]
    rows = [(k, rng.choice(pool) + rng.choice(["", "!", " (x)", " zz"]), rng.choice([None, 0.0, 4.0, 5.0, 9.5, 10.0, 14.99, 60.0, 300.5])) for k in range(160)]
    rows += [(200, None, 3.0), (201, "", 3.0), (202, " ?! ", None), (203, "qqqq wwww", 7.0)]
    got = {r["id"]: (r["best"], r["verdict"]) for r in titles.duplicate_titles(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_one_title_in_a_third_of_all_rows(spark):
    rows = [(k, "The Same Title", float(k % 50)) for k in range(3000)] + [(5000, "the same title", 500.0), (5001, "The same title.", 505.0), (5002, "other", None)]
    got = {r["id"]: r["best"] for r in titles.duplicate_titles(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got.pop(5002) is None and set(got.values()) == {1.0}
    alone = spark.createDataFrame([(1, "one title", 100.0), (2, "one title", 200.0)], SCHEMA)
    assert {r["verdict"] for r in titles.duplicate_titles(alone).collect()} == {"clear"}
    assert titles.duplicate_titles(alone.limit(0)).count() == 0
