"""Speaker edits in order: merges, reassignments, names and marks of a job, composed and applied to its segments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a job whose speakers may be edited.
EDITABLE = ["review", "paused", "error"]
MERGES = "array<struct<nth:long,speaker:string,becomes:string>>"


def invalid_reason(op: Column, speaker: Column, becomes: Column, idx: Column, label: Column) -> Column:
    """Why an edit can't be applied; null if it can."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    out = F.when((op == "merge") & ~(some(speaker) & some(becomes)), "merge needs two speakers").when((op == "merge") & (speaker == becomes), "merge needs two speakers")
    out = out.when((op == "reassign") & (idx.isNull() | ~some(becomes)), "reassign needs a segment and a speaker")
    out = out.when((op == "rename") & ~(some(speaker) & some(label)), "rename needs a speaker and a label")
    out = out.when((op == "mark_non_speech") & idx.isNull(), "mark_non_speech needs segments")
    known = F.coalesce(op.isin("merge", "reassign", "rename", "mark_non_speech"), F.lit(False))
    return out.when(~known, "unknown op")


def targets(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(request, job, ok, reason): the jobs that a request (request, job, apply_to_siblings) is about.

    They are its own job and, if it says so, all others of the same batch. A job refuses while it is at work and without a
    transcript (jobs: job, batch_id, status, transcribed); what one job refuses doesn't keep the others from taking part.
    """
    own = requests.select("request", "job", F.coalesce("apply_to_siblings", F.lit(False)).alias("wide"))
    first = own.join(jobs.select("job", "batch_id"), "job", "left")
    others = jobs.select(F.col("job").alias("sibling"), "batch_id").where("batch_id IS NOT NULL")
    more = first.where("wide").join(others, "batch_id").where(F.col("sibling") != F.col("job")).select("request", F.col("sibling").alias("job"))
    every = own.select("request", "job").unionByName(more).join(jobs.select("job", "status", "transcribed", F.lit(True).alias("there")), "job", "left")
    reason = F.when(F.col("there").isNull(), "unknown job").when(~F.coalesce(F.col("status").isin(EDITABLE), F.lit(False)), "busy").when(~F.coalesce("transcribed", F.lit(False)), "no checkpoint")
    return every.select("request", "job", reason.isNull().alias("ok"), reason.alias("reason"))


def _last(edits: DataFrame, op: str, by: list[str], value: str) -> DataFrame:
    return edits.where(F.col("op") == op).groupBy(*by).agg(F.max_by(F.struct(value, "nth"), "nth").alias("x"))


def edited(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """(job, idx, speaker, non_speech, merged): segments (job, idx, speaker) after the edits of their job in the order ``nth``.

    ``edits`` (job, nth, op, speaker, becomes, idx, label) are valid ones. A segment begins with what the last reassignment made it, else with its
    own speaker; of the merges that come after, each that names its speaker so far changes it (merges are few: each takes a
    speaker away). ``merged`` counts these. Marked segments keep their index and speaker.
    """
    moved = _last(edits, "reassign", ["job", "idx"], "becomes").select("job", "idx", F.col("x.becomes").alias("_to"), F.col("x.nth").alias("_since"))
    marked = edits.where("op = 'mark_non_speech'").select("job", "idx", F.lit(True).alias("_mute")).distinct()
    merge = F.struct(F.col("nth").cast("long").alias("nth"), "speaker", "becomes")
    merges = edits.where("op = 'merge'").groupBy("job").agg(F.array_sort(F.collect_list(merge)).alias("_merges"))
    rows = segments.select("job", "idx", "speaker").join(moved, ["job", "idx"], "left").join(marked, ["job", "idx"], "left").join(merges, "job", "left")
    later = F.filter(F.coalesce("_merges", F.array().cast(MERGES)), lambda m: m["nth"] > F.coalesce(F.col("_since").cast("long"), F.lit(-(1 << 62))))
    start = F.struct(F.coalesce("_to", "speaker").alias("speaker"), F.lit(0).alias("n"))

    def step(s: Column, m: Column) -> Column:
        hit = F.coalesce(s["speaker"] == m["speaker"], F.lit(False))
        return F.struct(F.when(hit, m["becomes"]).otherwise(s["speaker"]).alias("speaker"), (s["n"] + hit.cast("int")).alias("n"))

    end = F.aggregate(later, start, step)
    return rows.select("job", "idx", end.alias("e"), F.coalesce("_mute", F.lit(False)).alias("non_speech")).select("job", "idx", "e.speaker", "non_speech", F.col("e.n").alias("merged"))


def labels(edits: DataFrame) -> DataFrame:
    """(job, speaker, label): the last name given to each speaker, for display; speakers themselves stay as they are."""
    return _last(edits, "rename", ["job", "speaker"], "label").select("job", "speaker", "x.label")


def cast_after(cast: DataFrame, edits: DataFrame) -> DataFrame:
    """The voices (job, speaker, voice) without those of speakers that were merged into others."""
    gone = edits.where("op = 'merge'").select("job", "speaker").distinct()
    return cast.join(gone, ["job", "speaker"], "left_anti")


def cards(segments: DataFrame, labels: DataFrame, matches: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(job, nth, speaker, display, label, match, confirmed, talk_ms, lines): each job's speakers, who talks most first.

    A speaker is shown by the confirmed name, else the label, else its own id; a match (job, speaker, match) is a suggestion
    and never shown as the name. A segment that ends before it starts counts as a line without time.
    """
    talk = F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    rows = segments.groupBy("job", "speaker").agg(talk.alias("talk_ms"), F.count(F.lit(1)).alias("lines"))
    for side in (labels, matches, confirmed):
        rows = rows.join(side, ["job", "speaker"], "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("talk_ms"), "speaker"))
    return rows.select("job", nth.alias("nth"), "speaker", F.coalesce(some("confirmed"), some("label"), F.col("speaker")).alias("display"), some("label").alias("label"), "match", "confirmed", "talk_ms", "lines")


def cast_findings(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """(job, findings): speakers without a voice of their own; none in a job with a single speaker."""
    who = segments.where("speaker != ''").select("job", "speaker").distinct()
    rows = who.join(cast.select("job", "speaker", F.lit(True).alias("_cast")).distinct(), ["job", "speaker"], "left")
    counts = rows.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_cast").isNull()).alias("open"))
    return counts.select("job", F.when(F.col("n") > 1, F.col("open")).otherwise(0).alias("findings"))
