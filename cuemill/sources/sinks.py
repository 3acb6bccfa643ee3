"""Text sinks: SRT, VTT, plain transcripts, concat lists. One row per job holds the whole file's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.scalars import clock_ms


def _joined(lines: DataFrame, line: str, name: str, glue: str) -> DataFrame:
    """Lines of each job in the order of ``nth`` as one text."""
    rows = lines.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("nth", line))).alias("x"))
    return rows.select("job", F.array_join(F.transform("x", lambda r: r[line]), glue).alias(name))


def _numbered(cues: DataFrame) -> DataFrame:
    return cues.withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy("idx")))


def srt_text(cues: DataFrame) -> DataFrame:
    """(job, srt) of cues (job, idx, start_ms, end_ms, text)."""
    entry = F.concat(F.col("nth").cast("string"), F.lit("\n"), clock_ms(F.col("start_ms")), F.lit(" --> "), clock_ms(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    return _joined(_numbered(cues).withColumn("entry", entry), "entry", "srt", "\n")


def vtt_text(cues: DataFrame) -> DataFrame:
    entry = F.concat(clock_ms(F.col("start_ms"), "."), F.lit(" --> "), clock_ms(F.col("end_ms"), "."), F.lit("\n"), "text", F.lit("\n"))
    rows = _joined(_numbered(cues).withColumn("entry", entry), "entry", "vtt", "\n")
    return rows.withColumn("vtt", F.concat(F.lit("WEBVTT\n\n"), "vtt"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """(job, transcript): one line per segment, "[hh:mm:ss] speaker: text"."""
    entry = F.concat(F.lit("["), F.substring(clock_ms(F.col("start_ms")), 1, 8), F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), F.trim("text"))
    return _joined(_numbered(segments).withColumn("entry", entry), "entry", "transcript", "\n")


def concat_list(slides: DataFrame) -> DataFrame:
    """(job, list): pictures with their seconds; the last picture is repeated, as the format wants."""
    quoted = F.concat(F.lit("file '"), F.replace("image", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    entry = F.concat(quoted, F.lit("\nduration "), F.format_string("%.3f", (F.col("end_ms") - F.col("start_ms")) / 1000.0))
    rows = _numbered(slides).withColumn("entry", entry).withColumn("again", quoted)
    body = _joined(rows, "entry", "list", "\n")
    last = rows.groupBy("job").agg(F.max_by("again", "nth").alias("again"))
    return body.join(last, "job").select("job", F.concat(F.lit("ffconcat version 1.0\n"), "list", F.lit("\n"), "again", F.lit("\n")).alias("list"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header line; one per partition."""
    df.write.option("header", True).csv(path)
