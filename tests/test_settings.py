"""Catalogue, validation, rescue and respelling on small rows with nulls, sentinels and odd texts."""

from pyspark.sql import functions as F

from cuemill.operators import settings

RULES = "key string, kind string, low double, high double, sentinels array<double>, choices array<string>"


def one(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_model_size_and_note(spark):
    rows = [("Qwen-72B",), ("phi-14b",), ("plain",), (None,), ("gemma-9b",)]
    assert one(spark, settings.model_size(F.col("m")), rows, "m string") == [40.0, 14 * 0.6, 0.0, None, 9 * 0.6]
    notes = one(spark, settings.model_note(F.col("m")), rows, "m string")
    assert notes[3] is None and notes[4].startswith("Gemma series") and notes[2].startswith("Translation model")


def test_validation(spark):
    rules = spark.createDataFrame([("n", "int", 4.0, 24.0, [0.0], []), ("x", "float", 1.0, 2.0, [], []), ("f", "bool", None, None, [], []), ("c", "str", None, None, [], ["", "a"])], RULES)
    rows = [("n", "0"), ("n", "30"), ("n", "1.5"), ("n", None), ("x", "1.5"), ("x", "nan"), ("f", " ON "), ("f", None), ("c", ""), ("c", "b"), ("c", None), ("free", None), (None, "v")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, key string, value string")
    got = [(r["clean"], r["error"] is not None) for r in settings.validate(frame, rules).orderBy("i").collect()]
    assert got == [("0", False), (None, True), (None, True), (None, True), ("1.5", False), (None, True), ("true", False), ("false", False), ("", False), (None, True), (None, True), (None, False), ("v", False)]
    assert settings.validate(frame, rules).where("i = 1").first()["error"] == "n: 30 is outside 4–24 (or 0)"
    assert settings.validate(frame.limit(0), rules).count() == 0


def test_next_rescue(spark):
    rows = [("forbidden", []), ("forbidden", ["wait_preferred"]), ("gone", []), ("challenge-unsolved", ["preferred", "tv_client"]), (None, None), ("network", ["wait_preferred", "wait_any"]), ("unknown", list("abcdef"))]
    schema = "s string, t array<string>"
    assert one(spark, settings.next_rescue(F.col("s"), F.col("t")), rows, schema) == ["wait_preferred", "web_embedded", None, "wait_any", "simple", None, None]
    assert one(spark, settings.next_rescue(F.col("s"), F.col("t"), opted_in=True), rows[3:4], schema) == ["remote_components"]


def test_respelling(spark):
    says = {"kubectl": "cube control", "Kubectl apply": "$cube \\1", "c++": "see plus"}
    rows = [("run KUBECTL apply, kubectl2 and xkubectl",), ("C++!",), (None,), ("éc++",)]
    assert one(spark, settings.respell(F.col("t"), says), rows, "t string") == ["run $cube \\1, cube control2 and xkubectl", "see plus!", None, "éc++"]
    assert one(spark, settings.respell(F.col("t"), {}), rows[:1], "t string") == [rows[0][0]]
