import random
import re

from pyspark.sql import functions as F

from cuemill.operators import flags, phrases


def brute(texts, terms):
    out = set()
    for k, t in enumerate(texts):
        for p in terms:
            if t and p and p.strip() and re.search(r"(?<![^\W\d_])" + re.escape(p.strip()) + r"(?![^\W\d_])", t, re.IGNORECASE):
                out.add((k, p))
    return out


def found(spark, texts, terms):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    hits = phrases.phrase_hits(rows, spark.createDataFrame([(p,) for p in terms], "phrase string"), text="text", phrase="phrase", key=["k"])
    return hits, [(r["k"], r["phrase"]) for r in hits.collect()]


def test_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["new", "York", "C++", "é", "ÉTÉ", "2024", "a", "++", "(x)", "New-York", "don't", "no.", "ΣΑΣ", "café"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice([" ", "-", "", ", "]) for _ in range(n))
    texts = [text(rng.randint(0, 14)) for _ in range(150)] + [None, "", "12024", "x2024", "C++C++"]
    terms = sorted({text(rng.randint(1, 3)).strip() for _ in range(120)} | {"2024", "++", "+", "C++", " york ", ""}) + [None]
    _, got = found(spark, texts, terms)
    assert len(got) == len(set(got)) and set(got) == brute(texts, terms)


def test_ten_thousand_terms_meet_no_nested_loop(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 4)))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)]
    terms = set()
    while len(terms) < 10_000:
        terms.add(" ".join(word() for _ in range(rng.randint(1, 2))))
    hits, got = found(spark, texts, sorted(terms))
    want = {(k, t) for k, x in enumerate(texts) for t in terms & {" ".join(w) for n in (1, 2) for w in zip(*(x.split()[i:] for i in range(n)), strict=False)}}
    assert set(got) == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_misses_once_per_job(spark):
    rows = [(1, 0, 0, "The Red Line closes", "Die U-Bahn"), (1, 1, 5, "red line again", "Rote Linie"), (1, 2, 9, "RED LINE", "nichts"), (2, 0, 0, "a redline", "x"), (2, 1, 3, "red line", " ")]
    segments = spark.createDataFrame(rows, "job int, idx int, start_ms int, text string, translated string")
    terms = spark.createDataFrame([("Red Line", "rote linie"), ("again", "Die"), (" ", "x"), ("line", " ")], "term string, mapped string")
    got = flags.glossary_misses(segments, terms).select("job", "idx", "source_span", F.col("variants")[0].alias("v")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "Red Line", "rote linie"), (1, 1, "again", "Die")]
