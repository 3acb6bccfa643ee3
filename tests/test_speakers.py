import random

from pyspark.sql import functions as F

from cuemill.operators import speakers

EDITS = "job int, nth int, op string, speaker string, becomes string, idx int, label string"


def brute(segments, edits):
    out = {(j, i): [s, False, 0] for j, i, s in segments}
    for j, _, op, a, b, idx, _ in sorted(edits, key=lambda e: e[1]):
        for (job, i), row in out.items():
            if job != j:
                continue
            if op == "merge" and row[0] == a:
                row[0], row[2] = b, row[2] + 1
            if op == "reassign" and i == idx:
                row[0], row[2] = b, 0
            row[1] |= op == "mark_non_speech" and i == idx
    return sorted((j, i, *row) for (j, i), row in out.items())


def test_against_edits_applied_one_by_one(spark):
    rng = random.Random(7)
    segments = [(j, i, rng.choice(["S1", "S2", "S3", "S4"])) for j in range(5) for i in range(15)]
    edits = []
    for n in range(90):
        op, name = rng.choice(["merge", "reassign", "mark_non_speech", "rename"]), lambda: rng.choice(["S1", "S2", "S3", "S4", "S5"])
        edits.append((rng.randrange(4), n, op, name(), name(), rng.randrange(17), "x"))
    df = spark.createDataFrame(segments, "job int, idx int, speaker string").repartition(3)
    got = speakers.edited(df, spark.createDataFrame(edits, EDITS).repartition(2))
    assert sorted(tuple(r) for r in got.collect()) == brute(segments, edits)


def test_names_and_cast(spark):
    edits = spark.createDataFrame([(1, 0, "rename", "S1", None, None, "Guest"), (1, 2, "rename", "S1", None, None, "Host"), (1, 3, "merge", "S3", "S1", None, None)], EDITS)
    assert [tuple(r) for r in speakers.labels(edits).collect()] == [(1, "S1", "Host")]
    cast = spark.createDataFrame([(1, "S1", "source"), (1, "S3", "preset"), (2, "S3", "x")], "job int, speaker string, voice string")
    assert sorted(tuple(r) for r in speakers.cast_after(cast, edits).collect()) == [(1, "S1", "source"), (2, "S3", "x")]


def test_siblings_take_part_only_if_asked_and_may_refuse(spark):
    jobs = spark.createDataFrame([("a", "b1", "paused", True), ("b", "b1", "review", True), ("c", "b1", "synthesizing", True), ("d", "b1", "error", False), ("e", None, "paused", True), ("f", None, "paused", True)], "job string, batch_id string, status string, transcribed boolean")
    ask = lambda job, wide: {(r["job"], r["ok"], r["reason"]) for r in speakers.targets(spark.createDataFrame([(1, job, wide)], "request int, job string, apply_to_siblings boolean"), jobs).collect()}
    assert ask("a", False) == ask("a", None) == {("a", True, None)}
    assert ask("a", True) == {("a", True, None), ("b", True, None), ("c", False, "busy"), ("d", False, "no checkpoint")}
    assert ask("e", True) == {("e", True, None)} and ask("z", True) == {("z", False, "unknown job")}


def test_edits_that_cannot_be_applied(spark):
    rows = [("explode", None, None, None, None), ("merge", "S3", None, None, None), ("merge", "S1", "S1", None, None), ("reassign", None, "S1", None, None), ("rename", "S1", None, None, ""), ("mark_non_speech", None, None, None, None), ("mark_non_speech", None, None, 1, None), ("merge", "S3", "S1", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "op string, speaker string, becomes string, idx int, label string")
    got = [r[0] for r in df.select(speakers.invalid_reason(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["unknown op", "merge needs two speakers", "merge needs two speakers", "reassign needs a segment and a speaker", "rename needs a speaker and a label", "mark_non_speech needs segments", None, None, "unknown op"]


def test_cards_show_confirmed_names_then_labels_then_ids(spark):
    segments = spark.createDataFrame([(1, "S1", 0, 900), (1, "S2", 900, 3000), (1, "S3", 5000, 4000), (1, "S3", 0, 900)], "job int, speaker string, start_ms int, end_ms int")
    side = lambda name, *rows: spark.createDataFrame(list(rows), f"job int, speaker string, {name} string")
    got = speakers.cards(segments, side("label", (1, "S1", "Host"), (1, "S3", "")), side("match", (1, "S3", "Ann")), side("confirmed", (1, "S2", "Bob"))).orderBy("nth").collect()
    assert [(r["speaker"], r["display"], r["talk_ms"], r["lines"]) for r in got] == [("S2", "Bob", 2100, 1), ("S1", "Host", 900, 1), ("S3", "S3", 900, 2)]


def test_findings_of_the_cast(spark):
    segments = spark.createDataFrame([(1, "S1"), (2, "S1"), (2, "S2"), (3, "S1"), (3, "S2")], "job int, speaker string")
    cast = spark.createDataFrame([(3, "S1", "x"), (3, "S2", "y"), (2, "S9", "z")], "job int, speaker string, voice string")
    assert {r["job"]: r["findings"] for r in speakers.cast_findings(segments, cast).collect()} == {1: 0, 2: 2, 3: 0}
