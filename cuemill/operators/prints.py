"""Fingerprints of a job's stages: SHA-256 of canonical JSON, chained from stage to stage.

Canonical JSON is what ``json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))`` writes, in column
expressions that follow the value's type: keys sorted at every depth, nulls kept, numbers in Python's form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Each stage's version and what decides its output; an input that ends in _fingerprint is required.
STAGES = {
    "download": (1, ["source_fingerprint"]),
    "extract": (1, ["source_fingerprint", "auto_denoise", "keep_bg", "vad_enabled", "vad_threshold"]),
    "transcribe": (1, ["audio_fingerprint", "whisper_model", "source_lang", "initial_prompt", "asr_backend"]),
    "diarize": (1, ["audio_fingerprint", "speaker_mode", "diarization_model", "reference_audio_fingerprint", "skip_diarization", "same_language", "min_speakers", "max_speakers"]),
    "translate": (2, ["segments_fingerprint", "target_lang", "model", "context_hint", "glossary_fingerprint"]),
    "tts": (1, ["translation_fingerprint", "speaker_refs_fingerprint", "tts_engine", "voice_preset", "voice_style", "tts_speed", "voice_seed", "target_lang"]),
}
_CONTROLS = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"} | {k: f"\\u{k:04x}" for k in range(32) if k not in (8, 9, 10, 12, 13)}


def _quoted(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    spelt = out
    for k, escape in _CONTROLS.items():
        spelt = F.replace(spelt, F.lit(chr(k)), F.lit(escape))
    return F.concat(F.lit('"'), F.when(F.regexp_like(out, F.lit(r"[\x00-\x1f]")), spelt).otherwise(out), F.lit('"'))


def _float(x: Column) -> Column:
    """Python's form: the fewest digits that give the number back, plain from 1e-4 to 1e16, else with an exponent of two digits at least.

    Some Java versions write digits more than that: up to three are left out if the number stays the same.
    """
    parts = F.split(F.abs(x).cast("string"), "E")
    plain, shift = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))
    whole = F.regexp_extract(plain, r"^0*([0-9]*)\.", 1)
    all_digits = F.regexp_replace(F.replace(plain, F.lit("."), F.lit("")), "^0+", "")
    power = shift + F.when(whole != "", F.length(whole) - 1).otherwise(-F.length(F.regexp_extract(plain, r"\.(0*)", 1)) - 1)
    digits = F.regexp_replace(all_digits, "0+$", "")
    shorter = digits
    for dropped in (1, 2, 3):
        rounded = F.floor((digits.cast("decimal(20,0)") + 5 * 10 ** (dropped - 1)) / 10**dropped).cast("decimal(20,0)").cast("string")
        value = F.concat(rounded, F.lit("E"), (power - F.length(digits) + 1 + dropped).cast("string")).try_cast("double")
        shorter = F.when((F.length(digits) > 14) & (value == F.abs(x)), rounded).otherwise(shorter)
    # Rounding up from nines begins with a one, a place higher.
    power = power + F.when(F.startswith(digits, F.lit("9")) & F.startswith(shorter, F.lit("1")), 1).otherwise(0)
    digits = F.regexp_replace(shorter, "0+$", "")
    rest = F.substring(digits, F.lit(2), F.length(digits))
    tail = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(F.rpad(F.left(digits, power + 1), power + 1, F.lit("0")), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.abs(power).cast("string")
    far = F.concat(F.left(digits, F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(exponent, F.greatest(F.lit(2), F.length(exponent)), F.lit("0")))
    shown = F.when(x == 0, "0.0").when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(far)
    minus = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(minus, F.lit("Infinity"))).otherwise(F.concat(minus, shown))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A value's canonical JSON; ``kind`` is its type. Maps have string keys; a null is ``null``, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        members = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform(value, lambda x: canonical_json(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_quoted(k), F.lit(":"), canonical_json(value[k], kind.valueType)))
        text = F.concat(F.lit("{"), F.concat_ws(",", entries), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float(value.cast("double"))
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.NullType):
        text = F.lit("null")
    elif isinstance(kind, T.StringType):
        text = _quoted(value)
    else:
        raise ValueError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def value_hash(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def _list(*items: Column) -> Column:
    """Canonical JSON of a list whose items are canonical JSON."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def segment_prints(segments: DataFrame) -> DataFrame:
    """(job, segments_fingerprint, translation_fingerprint) of segments (job, idx, start, end in seconds, text, translated, speaker).

    The first covers text and times, the second what is spoken, when and by whom; order is by ``idx``.
    """
    seconds = lambda c: _float(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 3))
    stripped = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    spoken = F.coalesce(F.nullif(F.col("translated"), F.lit("")), F.col("text"))
    heard = _list(seconds("start"), seconds("end"), _quoted(stripped(F.col("text"))))
    said = _list(seconds("start"), _quoted(stripped(spoken)), _quoted(F.coalesce("speaker", F.lit(""))))
    rows = segments.select("job", F.struct("idx", heard.alias("a"), said.alias("b")).alias("x"))
    lists = rows.groupBy("job").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = lambda c: F.sha2(F.concat(F.lit("["), F.array_join(F.col(f"x.{c}"), ","), F.lit("]")), 256)
    return lists.select("job", whole("a").alias("segments_fingerprint"), whole("b").alias("translation_fingerprint"))


def stage_print(stage: str, inputs: DataFrame) -> Column:
    """The fingerprint of one stage from the columns of ``inputs``; null if a required input is null or empty.

    A column that is missing counts as null, so that a forgotten input never equals one that was off.
    """
    version, names = STAGES[stage]
    kinds = {f.name: f.dataType for f in inputs.schema.fields}
    fields = {"__stage": F.lit(f'"{stage}"'), "__version": F.lit(str(version))}
    fields |= {n: canonical_json(F.col(n), kinds[n]) if n in kinds else F.lit("null") for n in names}
    members = [F.concat(F.lit(f'"{n}":'), fields[n]) for n in sorted(fields)]
    value = F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")), 256)
    lacking = F.lit(False)
    for n in names:
        if n.endswith("_fingerprint"):
            lacking = lacking | (F.coalesce(F.col(n).cast("string"), F.lit("")) == "" if n in kinds else F.lit(True))
    return F.when(~lacking, value)


def stage_prints(jobs: DataFrame) -> DataFrame:
    """(job, stage, fingerprint): all stages of each job (job and the inputs of ``STAGES``), each on what the one before it made.

    Where a job gives no ``audio_fingerprint``, the print of its extract stage stands for its audio; then a changed input
    changes its own stage and those behind it.
    """
    first = jobs.withColumns({f"_{s}": stage_print(s, jobs) for s in ("download", "extract")})
    if "audio_fingerprint" not in jobs.columns:
        first = first.withColumn("audio_fingerprint", F.col("_extract"))
    later = first.withColumns({f"_{s}": stage_print(s, first) for s in STAGES if s not in ("download", "extract")})
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"_{s}").alias("fingerprint")) for s in STAGES])
    return later.select("job", F.inline(rows))
