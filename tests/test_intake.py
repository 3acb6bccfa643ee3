"""Metadata, gates, measurements, projections, and which flags a person sees."""

import hashlib

from pyspark.sql import functions as F

from cuemill.operators import flags, intake

LINE = "job long, idx long, start_ms long, text string, translated string, conf_mean double, conf_min double, logprob double"


def lines(spark, rows):
    return spark.createDataFrame([(1, k, 1000 * k, a, b, 0.9, 0.9, -0.1) for k, (a, b) in enumerate(rows)], LINE)


def names(spark, rows, target="ru", **options):
    found = flags.inconsistent_names(lines(spark, rows), target=target, stopwords=["the", "then"], **options)
    return sorted((r["idx"], r["source_span"], r["target_span"], tuple(r["variants"])) for r in found.collect())


def test_a_name_kept_in_one_line_and_rendered_in_another(spark):
    rows = [("We saw Kyoto today", "Мы видели Kyoto"), ("In Kyoto it rained", "В Киото шёл дождь"), ("Nothing here", "Ничего тут")]
    assert names(spark, rows) == [(0, "Kyoto", "Kyoto", ("Kyoto", "Киото"))]
    assert names(spark, rows, settled=["KYOTO"]) == []
    # The rendering stands in a line that doesn't hold the name: no rendering of it.
    assert names(spark, [*rows, ("Elsewhere", "Тут Киото")]) == []
    # Only ever the first word of a line: no evidence of a name.
    assert names(spark, [("Kyoto is far", "Kyoto далеко"), ("Kyoto rains", "Киото дождь")]) == []


def test_two_renderings_that_read_alike(spark):
    rows = [("We saw Kyoto today", "мы видели Киото"), ("In Kyoto it rained", "здесь Кёото дождь"), ("Then Kyoto slept", "потом Киото спал")]
    assert names(spark, rows) == [(0, "Kyoto", "Киото", ("Киото", "Кёото"))]
    # Two lines aren't enough, nor are two cases of one word.
    assert names(spark, rows[:2]) == []
    assert names(spark, [("We saw Kevin", "мы видели Кевин"), ("With Kevin now", "здесь Кевина"), ("Ask Kevin then", "спроси Кевин")]) == []


def test_names_left_in_latin(spark):
    rows = [("We met Marvin there", "мы Marvin"), ("And Marvin's dog", "и Marvin's пёс"), ("YouTube and NASA", "YouTube NASA YouTube NASA"), ("Once Ottilie", "раз Ottilie")]
    found = flags.untransliterated_names(lines(spark, rows), source="en", target="ru", stopwords=[], brands=["youtube"])
    assert [(r["idx"], r["source_span"]) for r in found.collect()] == [(0, "Marvin")]
    assert flags.untransliterated_names(lines(spark, rows), source="en", target="es", stopwords=[], brands=[]).count() == 0


def test_which_flags_are_shown(spark):
    def some(rows):
        return spark.createDataFrame([(j, i, s, k, r, flags.SCORES[r], w, w, []) for j, i, s, k, r, w in rows], "job long, idx long, start_ms long, kind string, reason string, score double, source_span string, target_span string, variants array<string>")

    strong = some([(1, k, 10 - k, "name", "name_inconsistent", f"n{k}") for k in range(4)])
    misses = some([(1, k, 10 - k, "term", "glossary_miss", f"t{k}") for k in range(3, 9)])
    latin = some([(1, 50, 0, "name", "name_untransliterated", "x"), (2, 0, 5, "name", "name_untransliterated", "y"), (2, 1, 1, "name", "name_untransliterated", "z")])
    faint = some([(2, 7, 0, "unclear", "low_asr", "q"), (3, 9, 4, "unclear", "low_asr", "q"), (3, 8, 2, "unclear", "low_asr", "q")])
    got = flags.shown(strong, misses, latin, faint).orderBy("job", "rank").collect()
    assert [(r["job"], r["rank"], r["idx"], r["source_span"]) for r in got] == [(1, 1, 3, "n3"), (1, 2, 2, "n2"), (1, 3, 1, "n1"), (1, 4, 0, "n0"), (1, 5, 8, "t8"), (2, 1, 1, "z"), (3, 1, 8, "q")]
    # A name that was asked about already, or on a line that has a flag, isn't asked again.
    asked = some([(1, 0, 0, "name", "name_inconsistent", "Kyoto")])
    again = some([(1, 5, 1, "name", "name_untransliterated", "kyoto"), (1, 0, 0, "name", "name_untransliterated", "other")])
    assert flags.shown(asked, asked.limit(0), again, faint.limit(0)).count() == 1


def test_metadata(spark):
    info = spark.createDataFrame(
        [(1, "My OFFICIAL video", None, "up", [str(k) for k in range(30)], None, None, "", "d" * 20_000, [(0.0, " a "), (1.0, " "), (2.0, None)]), (2, None, "ch", "up", None, ["Music"], None, None, None, None), (3, "x", "", None, [], [], "", "", "", [])],
        "id int, title string, channel string, uploader string, tags array<string>, categories array<string>, artist string, track string, description string, chapters array<struct<start_time:double,title:string>>",
    )
    got = {r["id"]: r for r in intake.curate(info).collect()}
    assert len(got[1]["tags"]) == 20 and len(got[1]["description"]) == 10_000 and [tuple(c) for c in got[1]["chapters"]] == [(0.0, "a")]
    assert [got[k]["is_music"] for k in (1, 2, 3)] == [True, True, False]
    assert [got[k]["channel"] for k in (1, 2, 3)] == ["up", "ch", None] and got[2]["tags"] == [] and got[2]["chapters"] == []


def test_gates(spark):
    rows = [(1, {"subtitles": "on"}, None, {"transcript": "flagged_only", "final_qc": "odd"}), (2, None, "", {"transcript": "on"}), (3, {"transcript": "off"}, "review_transcript", None), (4, None, "auto", {"final_qc": "on"})]
    jobs = spark.createDataFrame(rows, "id int, explicit map<string,string>, wizard_mode string, defaults map<string,string>")
    got = {r["id"]: {g: m for g, m in r["gates"].items() if m != "off"} for r in intake.resolved_gates(jobs).collect()}
    assert got == {1: {"subtitles": "on", "transcript": "flagged_only"}, 2: {}, 3: {}, 4: {}}
    bad = spark.createDataFrame([(1, {"translaton": "on", "subtitles": "maybe", "final_qc": "off"})], "id int, explicit map<string,string>")
    assert sorted(r["gate"] for r in intake.bad_gates(bad).collect()) == ["subtitles", "translaton"]
    again = spark.createDataFrame([(1, "translate", ["transcript", "translation", "final_qc"]), (2, "download", ["transcript"]), (3, "odd", ["x"])], "id int, stage string, cleared array<string>")
    assert {r["id"]: r["cleared"] for r in intake.rearmed(again).collect()} == {1: ["transcript"], 2: [], 3: ["x"]}
    stages = [("", ""), ("tts", ""), ("", "merge"), ("tts", "diarize"), (None, "merge")]
    got = spark.createDataFrame(stages, "a string, b string").select(intake.earlier_stage(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == ["", "tts", "merge", "diarize", "merge"]


def test_confidence_of_words(spark):
    rows = spark.createDataFrame([([(0.5,), (None,), (0.25,)],), ([],), (None,), ([(None,)],)], "w array<struct<probability:double>>")
    got = [r["c"] and tuple(r["c"]) for r in rows.select(intake.word_confidence(F.col("w")).alias("c")).collect()]
    assert got == [(0.375, 0.25), None, None, None]


def test_tokens_and_public_keys(spark):
    digest = lambda t, s: hashlib.sha256((s + t).encode()).hexdigest()
    keys = spark.createDataFrame([(1, "a", digest("x", "a"), False, None), (2, "b", digest("y", "b"), True, None), (3, "c", digest("z", "c"), None, 5)], "key_id int, salt string, hash string, revoked boolean, expires int")
    tokens = spark.createDataFrame([("x",), ("y",), ("z",), ("none",)], "token string")
    assert {r["token"]: r["key_id"] for r in intake.verified(tokens, keys, F.lit(4)).collect()} == {"x": 1, "y": None, "z": 3, "none": None}
    assert {r["token"]: r["key_id"] for r in intake.verified(tokens, keys, F.lit(5)).collect()}["z"] is None
    assert intake.public_keys(keys).columns == ["key_id", "revoked", "expires", "environment"]


def test_first_match_and_merges(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    right = spark.createDataFrame([("a", 7), ("a", 3), (None, 1)], "v string, id int")
    assert {(r["v"], r["matched"], r["known"]) for r in intake.first_match(left, right, "v", "id", "id").collect()} == {("a", 3, True), ("b", None, False), (None, None, False)}
    kept, fresh = spark.createDataFrame([(1, "old"), (2, "old")], "id int, x string"), spark.createDataFrame([(2, "new"), (3, "new")], "id int, x string")
    assert sorted(tuple(r) for r in intake.merged_events(kept, fresh, "id").collect()) == [(1, "old"), (2, "new"), (3, "new")]
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["x"]), (2, [], ["y"])], "k int, s array<string>, t array<string>")
    assert [(r["k"], r["pos"], r["s"], r["t"]) for r in intake.aligned(rows, "s", "t").collect()] == [(1, 0, "a", "x")]


def test_the_first_key_with_a_tokens_hash_decides(spark):
    sha = lambda salt, token: hashlib.sha256((salt + token).encode()).hexdigest()
    keys = spark.createDataFrame([(1, "s", sha("s", "x"), True, None), (2, "s", sha("s", "x"), False, None), (3, "s", sha("s", "y"), False, 9), (4, "t", sha("t", "y"), True, None)], "key_id int, salt string, hash string, revoked boolean, expires int")
    tokens = spark.createDataFrame([("x",), ("y",), ("y",), ("",), (None,)], "token string")
    found = intake.verified(tokens, keys, F.lit(5))
    assert sorted(((r["token"], r["key_id"]) for r in found.collect()), key=str) == sorted([("", None), (None, None), ("x", None), ("y", 3), ("y", 3)], key=str)
