"""

Minutes are DECIMAL(18,3), so that sums don't depend on the order of rows. ``*_SQL`` are the same tables for
the DuckDB equivalents, as WITH items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pinned clock of all queries over events: the end of their last day.
NOW = "2024-01-31 00:00:00"
STATUS = {"error": "error", "view": "running", "click": "paused", "signup": "cancelled", "purchase": "complete"}
LANGUAGES = ["es", "fr", "de", "ja"]
STAGES = ["extract", "transcribe", "translate", "tts", "assemble"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per event: id, created, status, duration (seconds), minutes (of source), n_langs, target_lang, batch_id and more."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    k = F.col("event_id")
    return e.select(
        k.alias("id"),
        F.col("ts").cast("timestamp").alias("created"),
        status.alias("status"),
        F.col("value").cast("decimal(18,3)").alias("minutes"),
        (F.pmod(k, F.lit(3)) + 1).cast("int").alias("n_langs"),
        F.array(*[F.lit(x) for x in LANGUAGES])[F.pmod(k, F.lit(4)).cast("int")].alias("target_lang"),
        F.col("user_id").alias("batch_id"),
        F.when(F.pmod(k, F.lit(10)) == 0, "showcase").otherwise("single").alias("batch_kind"),
        F.when(status == "error", F.concat(F.lit("stage "), F.pmod(k, F.lit(7)), F.lit(" failed"))).alias("error"),
        F.array(*[F.lit(x) for x in STAGES])[F.pmod(k, F.lit(5)).cast("int")].alias("stage"),
        F.when(F.pmod(k, F.lit(11)) == 0, "upload").otherwise("preset").alias("voice_mode"),
        (F.lit(0.5) + F.pmod(k, F.lit(16)) * F.lit(0.25)).alias("factor"),
        "props",
    )


_STATUS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS.items())
JOBS_SQL = f"""jobs AS (
    SELECT event_id AS id, ts AS created, CASE event_type {_STATUS_SQL} END AS status, CAST(value AS DECIMAL(18,3)) AS minutes,
           CAST(event_id % 3 + 1 AS INTEGER) AS n_langs, {LANGUAGES}[event_id % 4 + 1] AS target_lang, user_id AS batch_id,
           CASE WHEN event_id % 10 = 0 THEN 'showcase' ELSE 'single' END AS batch_kind,
           CASE WHEN event_type = 'error' THEN 'stage ' || (event_id % 7) || ' failed' END AS error,
           {STAGES}[event_id % 5 + 1] AS stage, CASE WHEN event_id % 11 = 0 THEN 'upload' ELSE 'preset' END AS voice_mode,
           0.5::DOUBLE + (event_id % 16) * 0.25::DOUBLE AS factor, props
    FROM events),
metered AS (
    SELECT *, CASE WHEN status IN ('error', 'cancelled', 'failed') THEN 0 ELSE minutes * n_langs END::DECIMAL(18,3) AS billable,
           CASE status WHEN 'complete' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'cancelled' THEN 'cancelled' WHEN 'paused' THEN 'attention'
                       WHEN 'running' THEN 'active' ELSE 'other' END AS state FROM jobs)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per turn: job, idx, speaker, text, start, end_ (milliseconds), dub_ms, translated, logprob, no_speech, cer, tier.

    Times are whole milliseconds (15 characters a second), so folds agree in every engine.
    """
    c = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text")
    length_ms = F.floor(size * 1000 / F.lit(15.0)).cast("long")
    c = c.withColumns({"n": size.cast("long"), "ms": length_ms})
    begin = F.coalesce(F.sum(F.col("ms") + 300).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17, F.lit(100))
    return c.withColumns({"start_ms": begin, "h": h}).select(
        F.col("conv_id").alias("job"),
        F.col("turn").alias("idx"),
        F.col("role").alias("speaker"),
        "text",
        F.col("start_ms").cast("long").alias("start_ms"),
        (F.col("start_ms") + F.col("ms")).cast("long").alias("end_ms"),
        F.floor(F.col("ms") * (F.lit(80) + F.pmod(F.col("h"), F.lit(60))) / 100).cast("long").alias("dub_ms"),
        F.when(F.col("h") % 20 == 0, F.col("text")).when(F.col("h") % 27 == 0, F.lit("")).otherwise(F.concat(F.lit("x "), F.col("text"), F.lit(" "), F.repeat(F.lit("ab "), F.pmod(F.col("h"), F.lit(9)).cast("int")))).alias("translated"),
        (-F.col("h") / F.lit(64.0)).alias("logprob"),
        (F.pmod(F.col("h") * 7, F.lit(100)) / F.lit(100.0)).alias("no_speech"),
        (F.pmod(F.col("h") * 3, F.lit(64)) / F.lit(64.0)).alias("cer"),
        F.pmod(F.col("h"), F.lit(4)).cast("int").alias("tier"),
        (F.col("h") % 5 != 0).alias("measured"),
        (F.col("h") % 13 != 0).alias("lang_match"),
    )


SEGMENTS_SQL = """segments AS (
    WITH c AS (SELECT *, length(text)::BIGINT AS n, floor(length(text) * 1000 / 15.0::DOUBLE)::BIGINT AS ms,
                      (conv_id * 31 + turn * 17) % 100 AS h FROM conversations),
    b AS (SELECT *, coalesce(sum(ms + 300) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM c)
    SELECT conv_id AS job, turn AS idx, role AS speaker, text, start_ms, start_ms + ms AS end_ms,
           floor(ms * (80 + h % 60) / 100)::BIGINT AS dub_ms,
           CASE WHEN h % 20 = 0 THEN text WHEN h % 27 = 0 THEN '' ELSE 'x ' || text || ' ' || repeat('ab ', (h % 9)::INTEGER) END AS translated,
           -h / 64.0::DOUBLE AS logprob, (h * 7 % 100) / 100.0::DOUBLE AS no_speech, (h * 3 % 64) / 64.0::DOUBLE AS cer, (h % 4)::INTEGER AS tier,
           h % 5 != 0 AS measured, h % 13 != 0 AS lang_match FROM b)"""
