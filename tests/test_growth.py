"""Work that must not grow faster than its input: what is broadcast, compared, cut and looked at."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx
from cuemill.operators import corpus_audit, folds, phrases
from cuemill.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_few_phrases_are_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"word{chr(97 + k % 26)} line here") for k in range(50)], "k int, text string")
    terms = spark.createDataFrame([("line here",), ("Worda",)], "phrase string")
    hits = lambda: phrases.phrase_hits(rows, terms, text="text", phrase="phrase", key=["k"])
    few, want = hits(), sorted(map(tuple, hits().collect()))
    assert len(want) == 52 and plan(few).count("BroadcastExchange") == 1
    monkeypatch.setattr(phrases, "SMALL_ROWS", 1)
    many = hits()
    assert "Broadcast" not in plan(many) and sorted(map(tuple, many.collect())) == want


def test_equal_titles_are_compared_once(spark, tmp_path):
    parts = [(k, ["The Title", "the title!", None, "other"][k % 4]) for k in range(400)] + [(1, "nation x"), (None, "nation x")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    nations = [(k, f"Nation {chr(97 + k)}") for k in range(25)] + [(None, "the title"), (3, None)]
    spark.createDataFrame(nations, "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    df = registry.QUERIES["duplicate_score"](spark, str(tmp_path))
    got = {r["p_partkey"]: r["best"] for r in df.collect()}
    ratio = lambda a, b: tx.difflib.SequenceMatcher(None, a, b).ratio()
    plain = lambda t: re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()
    want = {}
    for k, t in parts:
        best = max(ratio(plain(t), plain(n)) * (0.5 if k is not None and abs(k % 40 - j % 40) > 5 else 1) for j, n in nations if j is not None)
        want[k] = max(best, want.get(k, best))
    assert got == pytest.approx(want)
    # Python gets what an aggregate over titles gave.
    assert "HashAggregate" in plan(df).split("ArrowEvalPython")[1].split("ArrowEvalPython")[0]


def test_rounds_get_each_sides_best_pairs(spark, monkeypatch):
    rng, written = random.Random(4), []
    rows = [(k % 2, k, b, rng.choice([0.5, rng.random()])) for k in range(400) for b in range(3)]
    keep = folds.scratch.written
    monkeypatch.setattr(folds.scratch, "written", lambda df, label: written.append((label, out := keep(df, label))) or out)
    got = folds.greedy_pairs(spark.createDataFrame(rows, "grp long, a long, b long, score double")).collect()
    best, used = [], set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if not {(g, "a", a), (g, "b", b)} & used:
            used |= {(g, "a", a), (g, "b", b)}
            best.append((g, a, b, s))
    assert sorted(map(tuple, got)) == sorted(best)
    # Three pairs of each of three b in two groups.
    assert [df.count() for label, df in written if label == "pairs"][1] <= 18


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    texts = ["word, " * 3000, None, "  ", "a b\tc", "x" * 200 + " y"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = sorted(map(tuple, tx.chunk_rows(docs, 80).collect()))
    assert got == [(k, p, c) for k, t in enumerate(texts) for p, c in enumerate(tx.balanced_chunks(t, 80))]
    sent = []
    docs_like = type("Docs", (), {"select": lambda self, *c: self, "schema": spark.range(1).select(F.col("id").alias("doc_id")).schema, "mapInArrow": lambda self, run, fields: sent.append(run)})()
    tx.chunk_rows(docs_like, 80)
    monkeypatch.setattr(tx, "_HELD", 1000)
    out = list(sent[0](iter([pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})])))
    assert sum(b.num_rows for b in out) == len(got) and max(b.num_rows for b in out) < 30


def test_cosines_bring_vectors_to_length_one_once(spark):
    df = spark.createDataFrame([(k, [float(k + i) for i in range(1500)], k % 2) for k in range(40)], "vec_id long, embedding array<float>, label int").repartition(1).cache()
    df.count()
    begin = time.monotonic()
    got = corpus_audit.profile_scores(df, corpus_audit.centroids(df, "label", "embedding")).collect()
    # Once: a hundred thousand steps; anew for each component of each pair: hundreds of millions.
    assert len(got) == 80 and all(0.9 < r["score"] <= 1.0000001 for r in got) and time.monotonic() - begin < 25


def test_sentences_look_behind_at_marks_only(spark):
    begin = tx._STOP[: tx._STOP.index("(?<!")]
    assert begin == "(?=[.!?…])"
    text = "Dr. Smith came... “Why?” he said. No. 5 left!! J. Doe stayed (etc.) 7 days. " * 3
    got = spark.range(1).select(tx.sentences(F.lit(text)).alias("x")).first()["x"]
    assert " ".join(got) == text.strip() and got[:3] == ["Dr. Smith came...", "“Why?” he said.", "No. 5 left!!"]


def test_error_rate_of_near_and_far_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé日𝄞") for _ in range(n))
    pairs = [(word(rng.randint(1, 60)), word(rng.randint(1, 60))) for _ in range(60)]
    pairs += [(x[:k] + word(rng.randint(0, 12)) + x[k + 2 :], x) for x, _ in pairs for k in (0, 5, 30)]
    pairs += [("x " + a + " ab ab", a) for a, _ in pairs[:20]] + [(a, "x " + a) for a, _ in pairs[:20]]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").select("a", "b", scalars.error_rate(F.col("a"), F.col("b")).alias("x"))
    got = [(r["a"], r["b"], r["x"]) for r in df.collect()]
    assert [x for *_, x in got[:-2]] == pytest.approx([distance(a, b) / max(len(a), len(b)) for a, b in pairs]) and got[-2][2] is None and got[-1][2] is None
    long = spark.createDataFrame([(word(10_000) + "x",) for _ in range(20)], "a string").select(scalars.error_rate(F.concat(F.lit("x "), "a"), F.col("a")).alias("x"))
    begin = time.monotonic()
    assert all(r["x"] < 0.01 for r in long.collect()) and time.monotonic() - begin < 10
