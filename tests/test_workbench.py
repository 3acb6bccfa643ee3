import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cuemill.operators import folds, workbench


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, key):
    texts = ["", "hello", "naïve 日本"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(workbench.hmac_sha256(F.col("t"), key).alias("h")).collect()
    assert [r["h"] for r in got] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_overrides_are_clamped_and_null_changes_nothing(spark):
    cues = spark.createDataFrame([(1, 0, 1000, 2000), (1, 1, 3000, 4000)], "job int, idx int, start_ms long, end_ms long")
    changes = spark.createDataFrame([(1, 0, -900, None)], "job int, idx int, delta_start int, delta_end int")
    got = {r["idx"]: (r["start_ms"], r["end_ms"]) for r in workbench.override_cues(cues, changes).collect()}
    assert got == {0: (500, 2000), 1: (3000, 4000)}


def test_running_total_equals_one_window(spark):
    rows = spark.createDataFrame([(k, k % 7, k * k) for k in range(60)], "id int, b int, v long")
    got = {r["id"]: r["before"] for r in workbench.running_total(rows, F.col("b"), ["id"], "v").collect()}
    total, want = 0, {}
    for k in sorted(range(60), key=lambda k: (k % 7, k)):
        want[k], total = total, total + k * k
    assert got == want


def test_no_gate_is_left_once_all_are_cleared(spark):
    states = spark.createDataFrame([(1, 3), (2, 3), (3, 0)], "job int, nth int")
    gates = spark.createDataFrame(
        [(1, "a", 1, True, True, 5), (1, "b", 2, True, False, None), (1, "c", 3, True, False, 9), (2, "a", 1, True, False, 0), (2, "b", 2, False, False, 4), (3, "z", 1, True, False, 1)],
        "job int, gate string, at int, armed boolean, cleared boolean, findings int",
    )
    assert {r["job"]: r["gate"] for r in workbench.first_gate(states, gates).collect()} == {1: "b", 2: None, 3: None}


def test_slides_without_a_picture_extend_the_one_before(spark):
    rows = [(1, 0, None, 0, 5), (1, 1, "a", 5, 10), (1, 2, None, 10, 20), (1, 3, "a", 20, 30), (1, 4, "b", 30, 40)]
    got = workbench.slide_spans(spark.createDataFrame(rows, "job int, idx int, image string, start_ms int, end_ms int")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("a", 5, 30), ("b", 30, 40)]


def test_loudness_takes_the_last_block(spark):
    log = 'x {"input_i": "-9", "input_tp": "1", "input_lra": "2"}\n{"other": 1} {"input_i": "-inf", "input_tp": "-1.5", "input_lra": "7"} end'
    got = spark.createDataFrame([(log,), ("nothing",)], "t string").select(workbench.loudness(F.col("t")).alias("l")).collect()
    assert tuple(got[0]["l"]) == (None, -1.5, 7.0) and tuple(got[1]["l"]) == (None, None, None)


def segments(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "job long, idx long, start_ms long, end_ms long, speaker string, text string")


def test_continuations_join_until_a_sentence_ends(spark):
    rows = [(0, 1000, "A", "We went"), (1200, 2000, "A", "home."), (2400, 3000, "A", "Then"), (3100, 4000, "B", "no")]
    got = folds.merge_continuations(segments(spark, rows)).orderBy("idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 2000, "We went home."), (2400, 3000, "Then"), (3100, 4000, "no")]


def test_tiny_segments_go_to_a_neighbour(spark):
    rows = [(0, 300, "A", "Oh"), (500, 4000, "A", "that was long enough."), (4100, 4400, "A", "yes")]
    got = folds.absorb_tiny(segments(spark, rows)).collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 4400, "Oh that was long enough. yes")]


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [
        ("1. one\n2) two\nmore\n\n[3] three", 3, ["one", "two more", "three"]),
        ("1. one\n2. two\n4. four", 3, None),
        ("1. one\n2. two\n3. three", 2, None),
        ("1. one", 2, None),
        ("preamble\n**1.** one\n2: 2. again", 2, ["one", "2. again"]),
        ("1. one\n2. ", 2, None),
        (None, 1, None),
        ("", 0, []),
    ],
)
def test_numbered_replies(spark, text, n, want):
    rows = spark.createDataFrame([(text, n)], "t string, n int")
    assert rows.select(folds.numbered_reply(F.col("t"), F.col("n")).alias("r")).first()["r"] == want


def test_limits_and_speakers_end_a_joined_segment(spark):
    rows = [(0, 6000, "A", "a" * 100), (6100, 9000, None, "b" * 100), (9100, 12000, "A", "c" * 60), (12100, 12500, "B", "d"), (12600, 12700, None, "e")]
    got = folds.merge_continuations(segments(spark, rows)).orderBy("idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["speaker"], len(r["text"])) for r in got] == [(0, 9000, "A", 201), (9100, 12000, "A", 60), (12100, 12700, "B", 3)]


def test_a_tiny_segment_is_handed_forward(spark):
    rows = [(0, 3000, "A", "long enough to stay."), (3100, 3400, "B", "Oh"), (3500, 3900, "B", "no"), (4000, 8000, "B", "and then more.")]
    got = folds.absorb_tiny(segments(spark, rows)).orderBy("idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 3000, "long enough to stay."), (3100, 8000, "Oh no and then more.")]


def test_samples_are_chosen_in_turns(spark):
    rows = [(1, "A", 0, 5000), (1, "A", 6000, 6900), (1, "A", 8000, 28_000), (1, "B", 0, 20_000), (1, "B", 30_000, 42_000), (1, "B", 50_000, 61_000), (1, "B", 70_000, 79_000)]
    got = folds.reference_chunks(spark.createDataFrame(rows, "job long, speaker string, start_ms long, end_ms long")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [("A", 0, 5000), ("A", 6000, 6900), ("A", 8000, 23_000), ("B", 30_000, 42_000), ("B", 50_000, 61_000), ("B", 70_000, 79_000)]


def test_log_rows_around_failures(spark):
    log = spark.createDataFrame([(u, 100_000 * k) for u in (1, 2) for k in range(12)], "u long, seq long")
    failures = spark.createDataFrame([(1, 500_000), (1, 600_000), (2, 0)], "u long, at long")
    got = sorted((r["u"], r["at"] // 100_000, r["seq"] // 100_000) for r in workbench.around(log, "u", failures, before=3, after=2).collect())
    assert got == sorted([(1, 5, k) for k in range(3, 8)] + [(1, 6, k) for k in range(4, 9)] + [(2, 0, k) for k in range(3)])


def test_cues_are_fixed_only_if_that_helps(spark):
    cues = spark.createDataFrame([(1, 0, 0, 1000, "one two three four five six seven eight nine ten eleven"), (1, 1, 2000, 4000, "fine"), (2, 0, 0, 1000, "fine"), (2, 1, 1010, 2000, "also fine")], "job long, idx long, start_ms long, end_ms long, text string")
    got = {(r["job"], r["idx"]): (r["end_ms"], r["text"]) for r in folds.autofix_cues(cues).collect()}
    assert got[1, 0] == (1500, "one two three four five six seven eight\nnine ten eleven") and got[1, 1] == (4000, "fine")
    assert got[2, 0] == (930, "fine")


def test_pairs_are_one_to_one(spark):
    rows = [(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.9), (1, 2, 2, 0.1)]
    got = folds.greedy_pairs(spark.createDataFrame(rows, "grp long, a long, b long, score double")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 1), (2, 2)]


def test_rewrap_keeps_words_and_limits():
    text = "one two three, four five six seven eight nine ten eleven twelve"
    got = folds.rewrap(text, 24, 2)
    assert got.split() == text.split() and got.count("\n") <= 1


def test_order_statistics_of_large_groups(spark, monkeypatch):
    import numpy as np
    from cuemill.operators import console

    monkeypatch.setattr(console, "SMALL", 50)
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 30_000), ("b", 40), ("c", 2001)) for v in np.round(rng.normal(0, 5, n), 2)] + [("a", 1.0)] * 8000 + [("d", None), (None, 3.0)]
    got = {r["g"]: (r["p10"], r["p99"]) for r in console.linear_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", {"p10": 0.1, "p99": 0.99}).collect()}
    for g in ("a", "b", "c", None):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(tuple(np.percentile(own, [10, 99])))
    assert "d" not in got
    near = {r["g"]: (r["p50"], r["samples"]) for r in console.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5}).collect()}
    assert near["d"] == (None, 0) and near["a"] == (sorted(v for k, v in rows if k == "a")[18_999], 38_000)


def test_glossary_for_a_language(spark):
    rows = [(1, "de", "sun", "Sonne", None), (2, "", "sun", "SONNE", " zon "), (3, "fr", "sun", "soleil", "x"), (4, "DE-at", " sun ", " ", "son"), (5, None, "moon", None, None), (6, "de", "sky", "Himmel", "")]
    df = spark.createDataFrame(rows, "pos int, target_lang string, term string, dst string, say string")
    found = lambda lang: {r["term"]: (r["dst"], r["say"]) for r in workbench.glossary_for(df, lang).collect()}
    assert found("de-DE") == {"sun": ("SONNE", "son"), "sky": ("Himmel", None)}
    assert found("it") == {"sun": ("SONNE", "zon")} and found("") == {"sun": ("soleil", "son"), "sky": ("Himmel", None)}


def test_limits_of_the_fit(spark):
    from cuemill.operators import timeline

    segments = spark.createDataFrame([(1, k, t) for k, t in enumerate(["plain", " (angry) x", "(" + "y" * 40 + ")", None, "z"])], "job int, idx int, translated string")
    own = spark.createDataFrame([(1, 0, 9.0, -5), (1, 1, 0.5, 200), (1, 4, None, 10)], "job int, idx int, max_stretch double, pad_ms int")
    got = sorted(tuple(r) for r in timeline.fit_limits(segments, own, base=1.4).collect())
    assert got == [(1, 0, 2.5, 0), (1, 1, 1.07, 200), (1, 2, 1.4, 0), (1, 3, 1.4, 0), (1, 4, 1.4, 10)]
