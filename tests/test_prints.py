import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from cuemill.operators import prints

KIND = "struct<b:string,a:double,z:array<struct<y:int,x:map<string,double>>>,AB:boolean,n:bigint,`é`:array<array<string>>>"


def dumped(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def plain(value):
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, list) else value


def test_nested_values_equal_pythons_json(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "plain", 'q"uo\\te', "line\nend\t\x01\x1f\r\b\f", "Über 中 𝄞 /", "\x7f"])
    number = lambda: rng.choice([None, 0.0, -0.0, 1.0, 0.1, 1e16, 123456789012345680.0, 9999999999999998.0, 1e15, 1e-4, 1e-5, 1.5e-7, 2.5e300, 12345678.9, 1e7, 0.001, 100.25, rng.random(), rng.random() * 10 ** rng.randint(-20, 20), -3.25])
    rows = [(text(), number(), rng.choice([None, [], [(rng.randint(-5, 5), {"k": number(), "B": number(), "é": number()}), (None, None)]]), rng.choice([True, False, None]), rng.choice([None, 0, -(2**60)]), rng.choice([None, [], [[text(), text()], None, []]])) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in rows] + [(None,)], f"v {KIND}").repartition(2)
    kind = df.schema["v"].dataType
    for r in df.select("v", prints.canonical_json(F.col("v"), kind).alias("j"), prints.value_hash(F.col("v"), kind).alias("h")).collect():
        want = dumped(plain(r["v"]))
        assert r["j"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r[0] for r in odd.select(prints.canonical_json(F.col("x"), odd.schema["x"].dataType)).collect()] == ["NaN", "Infinity", "-Infinity"]


SEGMENTS = "job int, idx int, start double, end double, text string, translated string, speaker string"


def test_segments_and_translations(spark):
    rows = [(1, 1, 2.0, 3.5, " b\n", None, None), (1, 0, 0.12345, None, "a", "", "S1"), (2, 0, None, 1.0, None, "x", "é")]
    got = {r["job"]: tuple(r)[1:] for r in prints.segment_prints(spark.createDataFrame(rows, SEGMENTS)).collect()}
    sha = lambda v: hashlib.sha256(dumped(v).encode()).hexdigest()
    assert got[1] == (sha([[0.123, 0.0, "a"], [2.0, 3.5, "b"]]), sha([[0.123, "a", "S1"], [2.0, "b", ""]]))
    assert got[2] == (sha([[0.0, 1.0, ""]]), sha([[0.0, "x", "é"]]))


def inputs():
    return {"job": 1, "source_fingerprint": "s", "auto_denoise": True, "vad_threshold": 0.5, "whisper_model": "m", "speaker_mode": "auto", "reference_audio_fingerprint": "none", "segments_fingerprint": "g", "glossary_fingerprint": "l", "translation_fingerprint": "t", "speaker_refs_fingerprint": "r", "target_lang": "de"}


KINDS = {"job": "int", "auto_denoise": "boolean", "vad_threshold": "double"}


def found(spark, **changed):
    values = inputs() | changed
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {KINDS.get(k, 'string')}" for k in values))
    return {r["stage"]: r["fingerprint"] for r in prints.stage_prints(df).collect()}


def test_a_stage_covers_its_own_inputs(spark):
    base = found(spark)
    payload = {"__stage": "translate", "__version": 2, "segments_fingerprint": "g", "target_lang": "de", "model": None, "context_hint": None, "glossary_fingerprint": "l"}
    assert base["translate"] == hashlib.sha256(dumped(payload).encode()).hexdigest()
    assert None not in base.values() and len(set(base.values())) == 6


def test_a_changed_input_changes_its_stage_and_those_behind_it(spark):
    base = found(spark)
    differ = lambda **c: {s for s, p in found(spark, **c).items() if p != base[s]}
    assert differ(vad_threshold=0.25) == {"extract", "transcribe", "diarize"}
    assert differ(whisper_model="n") == {"transcribe"} and differ(speaker_mode=None) == {"diarize"}
    assert differ(target_lang="fr") == {"translate", "tts"} and differ(segments_fingerprint="h") == {"translate"}
    assert differ(source_fingerprint="other") == {"download", "extract", "transcribe", "diarize"}
    # What isn't known gives no print, and none for what was made from it.
    assert {s for s, p in found(spark, source_fingerprint="").items() if p is None} == {"download", "extract", "transcribe", "diarize"}
    assert {s for s, p in found(spark, glossary_fingerprint=None).items() if p is None} == {"translate"}
