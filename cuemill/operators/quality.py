"""Stage quality: scorers per job, roll-up, verdict rows and gates.

One grouped pass over segments gives all per-job figures; "worst" lists come from ranked windows per job,
so a job's segments are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx

#: Fixed values of the scoring rules.
LOGPROB_GOOD, LOGPROB_BAD, NO_SPEECH_HIGH = -0.2, -1.2, 0.6
RATIO_HIGH, RATIO_LOW = 2.0, 0.3
CER_BAD, CER_SCALE = 0.4, 0.8
STRETCH, STRETCH_SEVERE = 1.05, 1.15
LOUDNESS, LOUDNESS_SLACK = -16.0, 2.0
WEIGHTS = {"asr": 0.20, "translation": 0.25, "tts": 0.30, "timing": 0.15, "loudness": 0.10}
GATES = {"asr": 55.0, "translation": 60.0, "tts": 50.0}
HARD_UNTRANSLATED = 0.10


def _clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def asr_quality(segments: DataFrame) -> DataFrame:
    """Per job: scored segments, mean and tenth percentile of logprob, segments that look like no speech."""
    return segments.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count("logprob").alias("n_scored"),
        F.avg("logprob").alias("mean_logprob"),
        F.percentile("logprob", F.lit(0.1)).alias("p10_logprob"),
        F.count_if(F.coalesce("no_speech", F.lit(0.0)) > NO_SPEECH_HIGH).alias("high_no_speech"),
    )


def worst(segments: DataFrame, value: str, *, descending: bool, limit: int = 5) -> DataFrame:
    """(job, nth, idx): the segments with the worst values of each job; ties by idx."""
    order = F.desc(value) if descending else F.asc(value)
    ranked = segments.where(F.col(value).isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy(order, "idx")))
    return ranked.where(F.col("nth") <= limit).select("job", "nth", "idx")


def untranslated(source: Column, target: Column) -> Column:
    s, t = F.trim(source), F.trim(F.coalesce(target, F.lit("")))
    return (F.length(s) > 0) & ((F.length(t) == 0) | (t == s))


def bleed_quality(segments: DataFrame, *, target: str, source: str = "") -> DataFrame:
    """Per job: segments whose translation carries its source (count, the first 20 by index, evidence of the first five).

    Blank sources and untranslated segments (blank, or equal to the source) are left out; a job with nothing else has a count of 0.
    """
    s, t = F.trim("text"), F.trim(F.coalesce("translated", F.lit("")))
    rows = segments.where(F.length(s) > 0).withColumn("why", F.when(~untranslated(F.col("text"), F.col("translated")), tx.bleed(s, t, target, source)))
    # At most 20 rows of a job are gathered.
    found = rows.where("why != ''").withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy("idx")))
    counts = rows.groupBy("job").agg(F.count_if(F.col("why") != "").alias("bleed_count"))
    shown = found.where("nth <= 20").groupBy("job").agg(F.array_sort(F.collect_list(F.struct("nth", "idx", "why"))).alias("x"))
    indices, examples = F.col("x.idx"), F.slice(F.col("x.why"), 1, 5)
    return counts.join(shown, "job", "left").select("job", "bleed_count", indices.alias("bleed_indices"), examples.alias("bleed_examples"))


def word_confidences(segments: DataFrame) -> DataFrame:
    """Per job: mean of the segments' mean word confidence and the least of all words (null where none is known)."""
    means, least = F.avg(scalars.finite(F.col("word_conf_mean").cast("string"))), F.min(scalars.finite(F.col("word_conf_min").cast("string")))
    return segments.groupBy("job").agg(F.round(means, 4).alias("word_conf_mean"), F.round(least, 4).alias("word_conf_min"))


def bleed_share(lines: DataFrame, *, target: str, source: str) -> DataFrame:
    """Per run of a benchmark (run, idx, text, translated): lines that carry their source, the first ten of them, and their share in per cent."""
    rows = lines.select("run", "idx", (tx.bleed(F.col("text"), F.coalesce("translated", F.lit("")), target, source) != "").alias("hit"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("hit"), "idx")))
    shown = F.array_sort(F.collect_list(F.when(F.col("hit") & (F.col("nth") <= 10), F.col("idx"))))
    out = first.groupBy("run").agg(F.count_if("hit").alias("bleed_count"), F.array_join(shown, ",").alias("bleed_indices"), F.count(F.lit(1)).alias("n"))
    return out.select("run", "bleed_count", "bleed_indices", F.round(F.lit(100.0) * F.col("bleed_count") / F.col("n"), 1).alias("bleed_pct"))


def translation_quality(segments: DataFrame) -> DataFrame:
    """Per job: untranslated segments, length ratios and outliers (blank sources are left out)."""
    s, t = F.trim("text"), F.trim(F.coalesce("translated", F.lit("")))
    kept = segments.where(F.length(s) > 0).withColumn("none", untranslated(F.col("text"), F.col("translated")))
    kept = kept.withColumn("ratio", F.when(~F.col("none"), F.length(t) / F.length(s)))
    return kept.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if("none").alias("untranslated"),
        F.count_if((F.col("ratio") > RATIO_HIGH) | (F.col("ratio") < RATIO_LOW)).alias("outliers"),
        F.percentile("ratio", F.lit(0.9)).alias("ratio_p90"),
    )


def tts_quality(segments: DataFrame) -> DataFrame:
    """Per job: measured share, mean and p90 error rate, language matches, degraded takes (tier 0)."""
    cer = F.when(F.col("measured"), F.col("cer"))
    g = segments.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_with_qa"),
        F.count_if("measured").alias("n_measured"),
        F.avg(cer).alias("mean_cer"),
        F.percentile(cer, F.lit(0.9)).alias("p90_cer"),
        F.count_if(F.col("tier") == 0).alias("degraded"),
        F.count_if(F.col("measured") & F.col("lang_match")).alias("matched"),
    )
    return g.withColumns({"measured_pct": F.col("n_measured") / F.col("n_with_qa") * 100.0, "lang_match_rate": F.when(F.col("n_measured") > 0, F.col("matched") / F.col("n_measured"))}).drop("matched")


def tier_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job", "tier").agg(F.count(F.lit(1)).alias("n"))


def timing_quality(placements: DataFrame) -> DataFrame:
    """Per job, from (job, idx, src_start, src_end, dub_start, dub_end) in milliseconds: stretch and drift."""
    p = placements.where("dub_start IS NOT NULL AND dub_end IS NOT NULL AND src_end > src_start")
    p = p.withColumns({"stretch": (F.col("dub_end") - F.col("dub_start")) / (F.col("src_end") - F.col("src_start")), "drift": F.abs(F.col("dub_start") - F.col("src_start"))})
    g = p.groupBy("job").agg(F.count(F.lit(1)).alias("n_placed"), F.count_if(F.col("stretch") > STRETCH).alias("stretched"), F.max("stretch").alias("max_stretch"), F.avg("drift").alias("mean_drift_ms"))
    return g.withColumn("stretched_pct", F.col("stretched") / F.col("n_placed") * 100.0)


def scores(asr: DataFrame, translation: DataFrame, tts: DataFrame, timing: DataFrame, loudness: DataFrame | None = None) -> DataFrame:
    """Per job: the stages' scores from 0 to 100 (null where not measured) and their weighted mean; with ``loudness`` (job, lufs) its score too."""
    a = asr.select("job", _clamp(_clamp((F.col("mean_logprob") - LOGPROB_BAD) / F.lit(LOGPROB_GOOD - LOGPROB_BAD) * 100.0) - F.least(F.lit(20.0), F.col("high_no_speech") * 2.0)).alias("asr"))
    n = F.greatest(F.col("n_segments"), F.lit(1))
    r = translation.select("job", _clamp(F.lit(100.0) - F.col("untranslated") / n * 100.0 * 1.5 - F.col("outliers") / n * 100.0 * 0.5).alias("translation"))
    heard = F.coalesce(_clamp((F.lit(1.0) - F.col("mean_cer") / CER_SCALE) * 70.0, 0.0, 70.0), F.lit(70.0)) + F.col("measured_pct") / 100.0 * 30.0
    t = tts.select("job", F.when(F.col("measured_pct") > 0, _clamp(heard * F.coalesce("lang_match_rate", F.lit(1.0)))).alias("tts"))
    m = timing.select("job", _clamp(F.lit(100.0) - F.col("stretched_pct") * 0.5 - F.greatest(F.lit(0.0), F.col("max_stretch") - STRETCH_SEVERE) * 200.0).alias("timing"))
    rows = a.join(r, "job", "full").join(t, "job", "full").join(m, "job", "full")
    present = [k for k in WEIGHTS if k != "loudness" or loudness is not None]
    if loudness is not None:
        rows = rows.join(loudness.select("job", F.when(F.col("lufs").isNotNull(), loudness_score(F.col("lufs"))).alias("loudness")), "job", "left")
    total = sum((F.when(F.col(k).isNotNull(), F.lit(WEIGHTS[k])).otherwise(F.lit(0.0)) for k in present), F.lit(0.0))
    mean = sum((F.coalesce(F.col(k), F.lit(0.0)) * F.lit(WEIGHTS[k]) for k in present), F.lit(0.0))
    return rows.withColumn("overall", F.when(total > 0, mean / total))


def loudness_score(measured: Column) -> Column:
    """100, less 10 for each unit beyond the tolerance."""
    return _clamp(F.lit(100.0) - F.greatest(F.lit(0.0), F.abs(measured - LOUDNESS) - LOUDNESS_SLACK) * 10.0)


def verdicts(asr: DataFrame, translation: DataFrame, tts: DataFrame, timing: DataFrame) -> DataFrame:
    """(job, stage, kind, severity, n): what a person should look at."""

    def rows(df: DataFrame, stage: str, rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
        found = F.filter(F.array(*[F.when(hit, F.struct(F.lit(kind).alias("kind"), level.alias("severity"), n.cast("long").alias("n"))) for kind, hit, level, n in rules]), lambda x: x.isNotNull())
        return df.select("job", F.lit(stage).alias("stage"), F.explode(found).alias("v")).select("job", "stage", "v.*")

    warn, share = F.lit("warn"), lambda part, whole, limit, high, low: F.when(F.col(part) * 100 >= F.col(whole) * limit, high).otherwise(low)
    out = rows(asr, "asr", [("low confidence", F.col("mean_logprob") < -1.0, warn, F.col("n_scored")), ("no speech", F.col("high_no_speech") > 0, F.when(F.col("high_no_speech") > F.greatest(F.lit(2), F.floor(F.col("n_scored") / 20)), "warn").otherwise("info"), F.col("high_no_speech"))])
    out = out.unionByName(rows(translation, "translation", [("untranslated", F.col("untranslated") > 0, share("untranslated", "n_segments", 10, "serious", "warn"), F.col("untranslated")), ("outliers", F.col("outliers") > 0, warn, F.col("outliers"))]))
    out = out.unionByName(
        rows(
            tts,
            "tts",
            [
                ("degraded", F.col("degraded") > 0, share("degraded", "n_with_qa", 10, "serious", "warn"), F.col("degraded")),
                ("language", F.col("lang_match_rate") < 0.9, warn, F.col("n_measured")),
                ("error rate", F.col("p90_cer") > CER_BAD, warn, F.col("n_measured")),
                ("coverage", (F.col("measured_pct") > 0) & (F.col("measured_pct") < 50), F.lit("info"), F.col("n_measured")),
            ],
        )
    )
    return out.unionByName(rows(timing, "timing", [("stretched", F.col("stretched") > 0, F.when(F.col("stretched_pct") >= 10, "warn").otherwise("info"), F.col("stretched")), ("drift", F.col("mean_drift_ms") > 500, F.lit("info"), F.col("n_placed"))]))


def gates(scored: DataFrame, translation: DataFrame) -> DataFrame:
    """(job, stage, score, passed): a stage that isn't measured passes; damage stops a job whatever its score."""
    hard = translation.select("job", (F.col("untranslated") >= F.greatest(F.col("n_segments"), F.lit(1)) * HARD_UNTRANSLATED).alias("hard"), "untranslated")
    rows = scored.join(hard, "job", "left")
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("score"), F.lit(v).alias("threshold")) for k, v in GATES.items()])
    rows = rows.select("job", "hard", "untranslated", F.explode(stages).alias("g")).select("job", "hard", "untranslated", "g.*")
    stopped = (F.col("score") < F.col("threshold")) | ((F.col("stage") == "translation") & (F.col("untranslated") > 0) & F.coalesce("hard", F.lit(False)))
    return rows.select("job", "stage", "score", F.coalesce(~stopped, F.lit(True)).alias("passed"))


def reuse_gate(artifacts: DataFrame) -> DataFrame:
    """Artifacts with ``ok`` and ``why``: the first failed rule of the stage; null signals pass."""
    why = (
        F.when((F.col("stage") == "transcribe") & (F.col("word_conf") < 0.5), "low word confidence")
        .when((F.col("stage") == "transcribe") & (F.col("no_speech_ratio") > 0.5), "mostly no speech")
        .when((F.col("stage") == "translate") & (F.col("fallback_ratio") > 0.05), "untranslated lines")
        .when((F.col("stage") == "tts") & (F.col("failed_ratio") > 0.10), "failed takes")
    )
    return artifacts.withColumns({"why": why, "ok": why.isNull()})
