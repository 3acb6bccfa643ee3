"""Intake and records: metadata, candidates, projections, gates, measurements, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx

#: Review gates by the stage at whose end they stand, in order, and the one that each review mode arms.
BOUNDARIES = {"diarize": ["transcript"], "translate": ["translation", "voice_cast"], "assemble": ["subtitles"], "merge": ["final_qc"]}
WIZARD = {"review_transcript": "transcript", "review_translation": "translation", "review_voices": "voice_cast"}
MODES = ["off", "on", "flagged_only"]
STAGE_ORDER = ["download", "extract", "transcribe", "diarize", "translate", "tts", "assemble", "merge"]
GATES = [g for names in BOUNDARIES.values() for g in names]
#: The columns that leave the house, and those that never are stored.
PAYLOAD = ["status", "source", "target_lang", "error", "batch_id", "quality_gate", "pending_gate"]
REPORTED = ["id", "status", "title", "source_label", "source", "source_type", "target_lang", "source_lang", "model", "speaker_mode", "voice_preset", "voice_mode", "tts_speed", "wizard_mode", "mode", "created", "batch_id"]
LARGE = ["transcript_raw", "_pending_args", "_source_info"]
#: The share of the base speech rate that scripts have while nobody has measured the language.
SCRIPT_RATES = {"han": 0.30, "japanese": 0.42, "hangul": 0.55, "devanagari": 0.85, "arabic": 0.90, "thai": 0.80}
BASE_RATE = 10.6
#: Language names by code.
LANGUAGE_NAMES = {
    "en": "English", "ru": "Russian", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "pl": "Polish",
    "tr": "Turkish", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "ar": "Arabic", "hi": "Hindi", "nl": "Dutch", "uk": "Ukrainian",
    "sv": "Swedish", "th": "Thai", "vi": "Vietnamese", "cs": "Czech", "ro": "Romanian", "hu": "Hungarian", "bg": "Bulgarian", "el": "Greek",
    "fi": "Finnish", "id": "Indonesian", "no": "Norwegian", "da": "Danish", "bn": "Bengali", "ur": "Urdu", "fa": "Persian", "he": "Hebrew",
    "sw": "Swahili", "tl": "Tagalog", "ms": "Malay", "ta": "Tamil", "te": "Telugu", "mr": "Marathi", "gu": "Gujarati", "kn": "Kannada",
    "ml": "Malayalam", "sk": "Slovak", "hr": "Croatian", "sr": "Serbian", "sl": "Slovenian", "lt": "Lithuanian", "lv": "Latvian",
    "et": "Estonian", "ca": "Catalan", "is": "Icelandic", "af": "Afrikaans", "mk": "Macedonian", "sq": "Albanian", "bs": "Bosnian",
    "cy": "Welsh", "kk": "Kazakh", "az": "Azerbaijani", "uz": "Uzbek", "ka": "Georgian", "mn": "Mongolian", "ne": "Nepali",
    "si": "Sinhala", "my": "Burmese", "km": "Khmer", "lo": "Lao",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# ---------------------------------------------------------------- metadata


def curate(info: DataFrame) -> DataFrame:
    """``info`` with tags (20 at most), description (10,000 characters), chapters with titles only, and ``is_music``."""
    low = F.lower(F.coalesce("title", F.lit("")))
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    music = F.coalesce(F.array_contains("categories", "Music"), F.lit(False)) | named("artist") | named("track") | F.contains(low, F.lit("official video")) | F.contains(low, F.lit("official music video"))
    titled = F.filter(F.transform("chapters", lambda c: F.struct(c["start_time"].alias("start"), F.trim(c["title"]).alias("title"))), lambda c: c["title"] != "")
    return info.withColumns(
        {
            "tags": F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 20),
            "description": F.left(F.coalesce("description", F.lit("")), F.lit(10_000)),
            "channel": F.coalesce(F.nullif("channel", F.lit("")), "uploader"),
            "chapters": F.coalesce(titled, F.array().cast(info.select(titled.alias("c")).schema["c"].dataType)),
            "is_music": music,
        }
    )


def publish_meta(jobs: DataFrame, template: str = "Original: {source_url}") -> DataFrame:
    """(id, title, description, tags, is_private): translated texts first, the source's address behind them, 10 tags at most."""
    url = F.when(F.startswith("source", F.lit("http")), F.col("source")).otherwise(scalars.present(F.col("webpage_url")))
    title = F.coalesce(scalars.present(F.col("new_title")), scalars.present(F.col("title")), scalars.present(F.col("source_label")), F.col("id").cast("string"))
    tags = F.when(F.size("new_tags") > 0, F.col("new_tags")).otherwise(F.coalesce("tags", F.array().cast("array<string>")))
    description = F.concat_ws("\n\n", scalars.present(F.col("new_description")), F.replace(F.lit(template), F.lit("{source_url}"), url))
    return jobs.select("id", title.alias("title"), description.alias("description"), F.slice(tags, 1, 10).alias("tags"), F.lit(True).alias("is_private"))


def candidate(raw: DataFrame, *, music: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Feed entries in one form: typed numbers (null where they aren't any), flags, the watch address."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.col(c).try_cast("long")
    return raw.select(
        text("id").alias("video_id"), F.concat(F.lit("https://www.youtube.com/watch?v="), text("id")).alias("url"), text("title").alias("title"),
        scalars.parse_duration(F.col("duration")).alias("duration_sec"), number("view_count").alias("view_count"), number("rank").alias("rank"),
        number("category_id").alias("category_id"), F.coalesce(number("category_id") == music, F.lit(False)).alias("is_music"), *(keep or []),
    )


def candidate_details(raw: DataFrame) -> DataFrame:
    """``candidate`` with the channel, the change of rank, whether it is a short, and its picture's address."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    short = ~F.lower(F.trim(text("is_short"))).isin("", "0", "false", "none", "null")
    rows = raw.select("*", text("channel_title").alias("channel"), F.col("rank_delta").try_cast("long").alias("_delta"), short.alias("_short"), text("thumb_url").alias("_thumb"))
    extra = F.struct(F.col("channel"), F.col("_delta").alias("rank_delta"), F.col("_short").alias("is_short"), F.col("_thumb").alias("thumb_url"))
    return candidate(rows.withColumn("_x", extra), keep=["_x"]).select("*", "_x.*").drop("_x")


def first_match(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``left`` with ``matched`` (the first ``value`` of the rows of ``right`` with its key) and whether there is one."""
    first = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias("matched"))
    return left.join(first, key, "left").withColumn("known", F.col("matched").isNotNull())


# ---------------------------------------------------------------- projections


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't to be deleted (null keys stay)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def stored(jobs: DataFrame, *, keep: int = 5) -> DataFrame:
    """Jobs as they are stored: without large fields, the first lines of the transcript, and whether there were more."""
    return jobs.drop(*LARGE).withColumn("transcript_truncated", F.size("transcript") > keep).withColumn("transcript", F.slice("transcript", 1, keep))


def public_keys(keys: DataFrame) -> DataFrame:
    """Keys without hash and salt; those from before environments are live."""
    rows = keys.drop("hash", "salt")
    return rows.withColumn("environment", F.coalesce("environment", F.lit("live")) if "environment" in keys.columns else F.lit("live"))


def verified(tokens: DataFrame, keys: DataFrame, now: Column, *, order: str = "key_id") -> DataFrame:
    """(token, key_id): the key whose salted hash a token has, if it is active; null otherwise.

    Of several keys with that hash the first by ``order`` decides, even if it is revoked or has expired. A token is hashed
    once for each different salt; hashes then meet keys by equality. A blank or null token has no key.
    """
    active = ~F.coalesce("revoked", F.lit(False)) & F.coalesce(F.col("expires") > now, F.lit(True))
    some = tokens.where("token != ''").select("token").distinct()
    hashed = some.join(keys.select("salt").distinct(), F.lit(True)).withColumn("hash", scalars.salted_hash(F.col("token"), F.col("salt")))
    met = hashed.join(keys.select("salt", "hash", F.col(order).alias("_nth"), F.when(active, F.col("key_id")).alias("_key")), ["salt", "hash"])
    first = met.groupBy("token").agg(F.min_by(F.struct("_key"), "_nth").alias("k"))
    return tokens.join(first, "token", "left").select(*tokens.columns, F.col("k._key").alias("key_id"))


def payload(jobs: DataFrame) -> DataFrame:
    """What a webhook is told of a job, as JSON; the source's label where there is no title."""
    fields = [F.col("id").alias("job_id"), F.coalesce(F.nullif("title", F.lit("")), "source_label").alias("title"), F.col("duration").alias("duration_sec")]
    fields += [F.col(c) for c in PAYLOAD if c in jobs.columns]
    return jobs.select(F.col("id").alias("job_id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def bug_report(jobs: DataFrame) -> DataFrame:
    """(listed columns, stage, message, signature): text scrubbed; stage and message of the last error, else the older fields."""
    stage = F.coalesce(F.nullif(F.col("last_error.stage"), F.lit("")), "failed_stage", F.lit(""))
    message = F.coalesce(F.nullif(F.col("last_error.message"), F.lit("")), "error", F.lit(""))
    text = {f.name for f in jobs.schema if f.dataType.simpleString() == "string"}
    shown = [scalars.redact_secrets(F.col(c)).alias(c) if c in text else F.col(c) for c in REPORTED if c in jobs.columns]
    return jobs.select(*shown, stage.alias("stage"), scalars.redact_secrets(message).alias("message"), F.when(message != "", scalars.error_signature(stage, message)).otherwise("").alias("signature"))


def compact(jobs: DataFrame, columns: list[str], meta: list[str]) -> DataFrame:
    """Only the listed columns of jobs and fields of ``meta``."""
    kept = [F.struct(*[F.col(f"meta.{m}") for m in meta if m in jobs.schema["meta"].dataType.names]).alias("meta") if c == "meta" else F.col(c) for c in columns if c in jobs.columns]
    return jobs.select(*kept)


# ---------------------------------------------------------------- gates


def resolved_gates(jobs: DataFrame) -> DataFrame:
    """(id, gates): the mode of each gate: the caller's, else the review mode's, else the configured one.

    ``explicit`` and ``defaults`` are maps of gate to mode. A review mode that was sent at all, blank or not, keeps
    the configured modes out. Unknown configured modes are off.
    """
    wizard = _map(WIZARD)
    armed = F.transform_values(_map({g: "off" for g in GATES}), lambda g, _: F.when(F.get(F.array(F.try_element_at(wizard, F.col("wizard_mode"))), F.lit(0)) == g, "on").otherwise("off"))
    configured = F.transform_values(_map({g: "off" for g in GATES}), lambda g, _: F.coalesce(F.when(F.try_element_at("defaults", g).isin(MODES), F.try_element_at("defaults", g)), F.lit("off")))
    base = F.when(F.col("wizard_mode").isNull(), configured).otherwise(armed)
    return jobs.select("id", F.transform_values(base, lambda g, mode: F.coalesce(F.try_element_at("explicit", g), mode)).alias("gates"))


def bad_gates(jobs: DataFrame) -> DataFrame:
    """(id, gate, mode) that a caller may not send: an unknown gate or mode."""
    rows = jobs.select("id", F.explode("explicit").alias("gate", "mode"))
    return rows.where(~F.col("gate").isin(GATES) | ~F.coalesce(F.col("mode").isin(MODES), F.lit(False)))


def rearmed(jobs: DataFrame) -> DataFrame:
    """(id, cleared) after running ``stage`` again: gates at its boundary and later ones are to be passed anew."""
    kept = F.when(F.lit(False), F.col("cleared"))
    for at, stage in enumerate(STAGE_ORDER):
        later = [g for s, names in BOUNDARIES.items() if STAGE_ORDER.index(s) >= at for g in names]
        kept = kept.when(F.col("stage") == stage, F.array_except("cleared", F.array(*[F.lit(g) for g in later]).cast("array<string>")))
    return jobs.select("id", F.coalesce(kept, "cleared").alias("cleared"))


def earlier_stage(a: Column, b: Column) -> Column:
    """The earlier of two ceilings; a blank one is none."""
    place = _map({s: k for k, s in enumerate(STAGE_ORDER)})
    x, y = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    return F.when(x.isNull(), F.coalesce(y, F.lit(""))).when(y.isNull(), x).when(F.try_element_at(place, x) <= F.try_element_at(place, y), x).otherwise(y)


# ---------------------------------------------------------------- measurements


def word_confidence(words: Column) -> Column:
    """(mean, least) of the words' probabilities to four places; null without any."""
    p = F.filter(F.transform(words, lambda w: w["probability"]), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(p) > 0, F.struct(F.round(total / F.size(p), 4).alias("mean"), F.round(F.array_min(p), 4).alias("least")))


def stage_quality(segments: DataFrame) -> DataFrame:
    """Per job what is recorded beside a stage's output: confidence and silence, untranslated lines, missing and failed takes."""
    src, tgt = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("translated", F.lit("")))
    none = (src != "") & ((tgt == "") | (tgt == src))
    share = lambda hit, of: F.round(F.count_if(hit) / F.nullif(of, F.lit(0)), 4)
    return segments.groupBy("job").agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.avg("word_conf"), 4).alias("word_conf_mean"),
        share(F.col("no_speech") > 0.5, F.count("no_speech")).alias("no_speech_ratio"),
        share(none, F.count(F.lit(1))).alias("fallback_ratio"),
        F.count_if(F.coalesce(F.col("audio") == "", F.lit(True))).alias("missing_audio"),
        share(F.col("qa_score") > 0.4, F.count("qa_score")).alias("failed_qa_ratio"),
    )


def measured(lines: DataFrame, *, language: str) -> DataFrame:
    """Per run (``run``, ``text``, ``translated``): copied lines, prose about the task, lines in script, digits kept, mean length ratio."""
    src, tgt = F.col("text"), F.coalesce("translated", F.lit(""))
    kept = F.sum(tx.digits(tgt, language)) / F.nullif(F.sum(tx.digits(src)), F.lit(0))
    scripted = F.lit(None).cast("double") if tx.script_of(language) == "latin" else F.count_if(tx.in_script(tgt, language)) / F.count(F.lit(1))
    return lines.groupBy("run").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.trim(src) == F.trim(tgt)).alias("fallback"),
        F.count_if(F.regexp_like(tgt, F.lit(tx.META_PROSE))).alias("meta"),
        scripted.alias("script_ok"),
        F.least(kept, F.lit(1.0)).alias("digits_kept"),
        F.avg(F.length(tgt) / F.greatest(F.length(F.trim(src)), F.lit(1))).alias("len_ratio"),
    )


def speech_rates(languages: DataFrame, rates: DataFrame) -> DataFrame:
    """(lang, rate, measured): characters a second as measured, else the base rate times its script's share."""
    code = F.left(F.lower("lang"), F.lit(2))
    share = F.coalesce(F.try_element_at(_map(SCRIPT_RATES), F.try_element_at(_map(tx.SCRIPT_OF), code)), F.lit(1.0))
    rows = languages.join(rates.select(F.col("code"), F.col("rate").alias("known")), code == F.col("code"), "left")
    return rows.select("lang", F.coalesce("known", F.lit(BASE_RATE) * share).alias("rate"), F.col("known").isNotNull().alias("measured"))


def language_name(code: Column) -> Column:
    """The name of a language code, regions aside; an unknown code as it is."""
    return F.coalesce(F.try_element_at(_map(LANGUAGE_NAMES), scalars.base_language(code)), F.trim(code))


def plausible_batches(lines: DataFrame, *, language: str = "") -> DataFrame:
    """(batch, plausible): whether every line of a batch can be a translation."""
    return lines.groupBy("batch").agg(F.bool_and(tx.rejected(F.col("text"), F.col("translated"), language=language).isNull()).alias("plausible"))


def findings(rows: DataFrame, key: str) -> DataFrame:
    """Counts of findings by severity, and ok: nothing is lost."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("loss", "warn", "info")]
    return rows.groupBy(key).agg(*counts, F.bool_and(F.col("severity") != "loss").alias("ok"))


def glossary_block(terms: DataFrame, key: str, *, limit: int = 60) -> DataFrame:
    """(key, block): the first terms of a glossary as lines of a prompt."""
    line = F.concat(F.lit("  - "), F.col("term"), F.lit(" → "), F.col("mapped"))
    first = terms.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("nth") <= limit)
    lines = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("l"))
    return lines.select(key, F.concat(F.lit("\nAlways use these translations for these terms:\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("block"))


# ---------------------------------------------------------------- merges


def aligned(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Two arrays side by side: one row for each position that both have."""
    n = F.least(F.size(a), F.size(b))
    return rows.select(*[c for c in rows.columns if c not in (a, b)], F.posexplode(F.slice(F.arrays_zip(a, b), F.lit(1), n)).alias("pos", "z")).select("*", f"z.{a}", f"z.{b}").drop("z")


def merged_events(kept: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored and new events by id; a new one stands for a stored one."""
    rows = kept.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    others = [c for c in kept.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "_new").alias("r")).select(key, "r.*")


def either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All keys of two tables, with the columns of both."""
    return a.join(b, key, "full")


def reusable_takes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(job, idx, reused): whether the old audio stays: same translation by the same speaker, and there is audio."""
    known = old.where("audio IS NOT NULL AND audio != ''").select("job", "idx", F.col("translated").alias("said"), F.col("speaker").alias("who"))
    rows = new.join(known, ["job", "idx"], "left")
    return rows.select("job", "idx", F.coalesce(F.col("translated") == F.col("said"), F.lit(False)).__and__(F.col("speaker").eqNullSafe(F.col("who"))).alias("reused"))


def appended_notes(old: DataFrame, new: DataFrame, *, most: int = 100) -> DataFrame:
    """(job, at, note): the last notes of each job, new ones behind old ones."""
    rows = old.withColumn("later", F.lit(0)).unionByName(new.withColumn("later", F.lit(1)))
    w = Window.partitionBy("job").orderBy(F.desc("later"), F.desc("at"), F.desc("note"))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("job", "at", "note")
