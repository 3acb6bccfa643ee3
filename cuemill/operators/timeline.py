"""Timelines: overlap joins, coalescing, gaps, remapping, placement folds, cues.

Times are in milliseconds. Range joins go through fixed-width buckets (an equi-join that shuffles on
job and bucket), and folds are ``aggregate`` over one job's sorted segments: parallel over jobs, serial
within one, as the computation is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.operators.rows import once

GAP_MS, PAD_MS, JOIN_MS = 80, 100, 50


def _buckets(start: str, end: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)))


def overlap_speaker(segments: DataFrame, turns: DataFrame, *, width: int = 10_000, none: str = "SPEAKER_00") -> DataFrame:
    """The speaker of the single turn that overlaps a segment most; ties go to the earlier turn.

    ``segments`` (job, idx, start_ms, end_ms), ``turns`` (job, pos, t_start, t_end, who).
    """
    a = segments.select("job", "idx", "start_ms", "end_ms", _buckets("start_ms", "end_ms", width).alias("b"))
    b = turns.select(F.col("job"), "pos", "t_start", "t_end", "who", _buckets("t_start", "t_end", width).alias("b"))
    hit = a.join(b, ["job", "b"]).where("start_ms < t_end AND end_ms > t_start")
    overlap = F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start")
    # A pair that meets in several buckets gives equal rows; the maximum takes one.
    best = hit.groupBy("job", "idx").agg(F.max_by("who", F.struct(overlap, -F.col("pos"))).alias("who"), F.max(overlap).alias("overlap_ms"))
    return segments.select("job", "idx").join(best, ["job", "idx"], "left").select("job", "idx", F.coalesce("who", F.lit(none)).alias("who"), F.coalesce("overlap_ms", F.lit(0)).alias("overlap_ms"))


def coalesce_intervals(intervals: DataFrame, *, pad: int = PAD_MS, join: int = JOIN_MS) -> DataFrame:
    """(job, start_ms, end_ms): padded intervals, merged where the next begins within ``join`` of the running end."""
    w = Window.partitionBy("job").orderBy("s", "e")
    p = intervals.select("job", F.greatest(F.col("start_ms") - pad, F.lit(0)).alias("s"), (F.col("end_ms") + pad).alias("e"))
    p = p.withColumn("before", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("island", F.sum(F.when(F.col("before").isNull() | (F.col("s") > F.col("before") + join), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("job", "island").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).drop("island")


def longest_gap(placed: DataFrame, totals: DataFrame, *, least: int = 3000, trim: int = 500) -> DataFrame:
    """Per job: the longest span without speech (before, between or after segments), trimmed at both ends."""
    w = Window.partitionBy("job").orderBy("start_ms", "end_ms")
    p = placed.where("end_ms > start_ms").withColumn("cursor", F.coalesce(F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    between = p.select("job", F.col("cursor").alias("from_ms"), (F.col("start_ms") - F.col("cursor")).alias("gap"))
    tail = totals.join(placed.groupBy("job").agg(F.max("end_ms").alias("last")), "job").select("job", F.col("last").alias("from_ms"), (F.col("total_ms") - F.col("last")).alias("gap"))
    spans = between.unionByName(tail).where(F.col("gap") >= least)
    best = spans.groupBy("job").agg(F.max(F.struct("gap", -F.col("from_ms"))).alias("m"))
    return best.select("job", (-F.col("m.col2") + trim).alias("from_ms"), (F.col("m.gap") - 2 * trim).alias("length_ms"))


def remap(times: DataFrame, speech: DataFrame) -> DataFrame:
    """Times on the speech-only clock (job, key, t) back on the original one, through speech intervals.

    The interval is the first whose running length reaches t; times past the end clamp to the last end.
    """
    w = Window.partitionBy("job").orderBy("start_ms")
    s = speech.withColumn("cum", F.sum(F.col("end_ms") - F.col("start_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = times.join(s, "job").where("t <= cum")
    found = hit.groupBy("job", "key", "t").agg(F.min(F.struct("cum", "start_ms", "end_ms")).alias("m"))
    last = s.groupBy("job").agg(F.max("end_ms").alias("last"))
    out = times.join(found, ["job", "key", "t"], "left").join(last, "job", "left")
    return out.select("job", "key", "t", F.coalesce(F.col("m.end_ms") - (F.col("m.cum") - F.col("t")), "last", "t").alias("original_ms"))


def next_start(segments: DataFrame, total: str) -> DataFrame:
    """Each segment with the next one's start; the last one's is the total."""
    w = Window.partitionBy("job").orderBy("idx")
    return segments.withColumn("next_start", F.coalesce(F.lead("start_ms").over(w), F.col(total)))


def place(segments: DataFrame, *, gap: int = GAP_MS) -> DataFrame:
    """Dubbed segments one after another: a start is at least the previous end plus ``gap``.

    ``segments`` (job, idx, start_ms, dub_ms). The fold carries only the end, so it has a closed form:
    a running maximum of start minus the time taken by the segments before.
    """
    w = Window.partitionBy("job").orderBy("idx")
    before = F.coalesce(F.sum(F.col("dub_ms") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = segments.withColumn("before", before)
    start = F.max(F.col("start_ms") - F.col("before")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    return p.withColumn("dub_start", start).withColumn("dub_end", F.col("dub_start") + F.col("dub_ms")).drop("before")


def fit(segments: DataFrame, *, gap: int = GAP_MS, most: int = 1400) -> DataFrame:
    """Placement with compression: (job, idx, placed, speed in thousandths), folded over each job's segments.

    A segment's room ends ``gap`` before the next start; if it is longer than 1.02 times the room (and
    the room exceeds 200 ms) it is sped up, at most by ``most`` thousandths.
    """
    rows = segments.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "dub_ms", "next_start"))).alias("s"))
    empty = F.array().cast("array<struct<idx:bigint,placed:bigint,speed:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("end"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.when(acc["end"] > 0, F.greatest(x["start_ms"], acc["end"] + gap)).otherwise(x["start_ms"])
        room = x["next_start"] - gap - start
        roomy = (room <= 200) | (x["dub_ms"] * 100 <= room * 102)
        speed = F.when(roomy, 1000).otherwise(F.least(F.floor(x["dub_ms"] * 1000 / F.greatest(room, F.lit(1))), F.lit(most))).cast("long")
        end = (start + F.floor(x["dub_ms"] * 1000 / speed)).cast("long")
        return F.struct(end.alias("end"), F.concat(acc["out"], F.array(F.struct(x["idx"].alias("idx"), start.cast("long").alias("placed"), speed.alias("speed")))).alias("out"))

    return rows.select("job", F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("p")).select("job", "p.*")


def clamp_cues(cues: DataFrame, *, least: int = 500) -> DataFrame:
    """(job, idx, start_ms, end_ms) so that no cue begins before the previous end and each lasts ``least``.

    An end is the largest of the own end, the own start plus ``least`` and the previous end plus ``least``: less
    ``least`` for each cue before, that is a running maximum.
    """
    w = Window.partitionBy("job").orderBy("idx")
    steps = (F.row_number().over(w) * least).cast("long")
    own = F.greatest("end_ms", F.col("start_ms") + least, F.lit(least))
    rows = cues.select("job", "idx", "start_ms", "end_ms", steps.alias("steps")).withColumn("own", own - F.col("steps"))
    rows = rows.withColumn("last", (F.max("own").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("steps")).cast("long"))
    start = F.greatest(F.col("start_ms"), F.coalesce(F.lag("last").over(w), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("job", "idx", start.alias("start_ms"), F.col("last").alias("end_ms"))


def cue_metrics(cues: DataFrame) -> DataFrame:
    """Cues (job, idx, start_ms, end_ms, text) with lines, longest line, characters per second and gap to the next."""
    w = Window.partitionBy("job").orderBy("idx")
    lines = F.split("text", "\n")
    length = F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long")
    return cues.select(
        "job",
        "idx",
        "start_ms",
        "end_ms",
        F.size(lines).cast("long").alias("lines"),
        F.array_max(F.transform(lines, F.length)).cast("long").alias("chars_per_line"),
        F.when(F.col("end_ms") > F.col("start_ms"), length * 1000 / (F.col("end_ms") - F.col("start_ms"))).alias("cps"),
        (F.lead("start_ms").over(w) - F.col("end_ms")).alias("gap_ms"),
    )


def cue_violations(metrics: DataFrame, *, line: int = 42, lines: int = 2, cps: float = 17.0, gap: int = 80) -> DataFrame:
    """(job, idx, kind, value): one row per limit that a cue breaks."""
    rule = lambda kind, hit, value: F.when(hit, F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value")))
    found = F.array(
        rule("line_too_long", F.col("chars_per_line") > line, F.col("chars_per_line")),
        rule("too_many_lines", F.col("lines") > lines, F.col("lines")),
        rule("cps_exceeded", F.col("cps") > cps, F.col("cps")),
        rule("gap_too_small", F.col("gap_ms") < gap, F.col("gap_ms")),
    )
    return metrics.select("job", "idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("job", "idx", "v.*")


def narration(units: DataFrame, *, lead_in: int = 800, slide_lead: int = 400, sentence_gap: int = 250, slide_gap: int = 700) -> DataFrame:
    """(job, slide, idx, start_ms, end_ms): lines on one clock; every start is a sum of what lies before."""
    w = Window.partitionBy("job").orderBy("slide", "idx")
    first = F.row_number().over(Window.partitionBy("job", "slide").orderBy("idx")) == 1
    very_first = F.row_number().over(w) == 1
    wait = F.when(very_first, lead_in).when(first, slide_gap + slide_lead).otherwise(sentence_gap)
    u = units.withColumn("wait", wait).withColumn("end_ms", F.sum(F.col("wait") + F.col("length_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.select("job", "slide", "idx", (F.col("end_ms") - F.col("length_ms")).alias("start_ms"), "end_ms")


def line_batches(lines: DataFrame, *, most_lines: int = 8, most_chars: int = 800) -> DataFrame:
    """(job, idx, batch): lines in order, in greedy batches under both caps."""
    rows = lines.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("chars").cast("long").alias("chars")))).alias("s"))
    empty = F.array().cast("array<struct<idx:bigint,batch:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= most_lines) | (acc["c"] + x["chars"] > most_chars))
        b = (acc["b"] + full.cast("long")).cast("long")
        return F.struct(
            b.alias("b"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).cast("long").alias("n"),
            F.when(full, x["chars"]).otherwise(acc["c"] + x["chars"]).cast("long").alias("c"),
            F.concat(acc["out"], F.array(F.struct(x["idx"].alias("idx"), b.alias("batch")))).alias("out"),
        )

    return rows.select("job", F.explode(F.aggregate("s", zero, step, lambda a: a["out"])).alias("p")).select("job", "p.*")


def split_long(segments: DataFrame, *, longest: int = 15_000) -> DataFrame:
    """(job, idx, part, start_ms, end_ms, text): segments over ``longest`` cut after the sentence end nearest the middle."""
    s = once(segments, n=F.length("text"), _pieces=F.regexp_extract_all("text", F.lit(r"(?s).*?[.!?]\s"), 0))
    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("far"), F.lit(None).cast("int").alias("cut"))

    def nearer(best: Column, piece: Column) -> Column:
        at = best["at"] + F.length(piece)
        far = F.abs(at * 2 - F.col("n"))
        better = (at > 20) & (at < F.col("n") - 20) & (best["far"].isNull() | (far < best["far"]))
        return F.struct(at.alias("at"), F.when(better, far).otherwise(best["far"]).alias("far"), F.when(better, at).otherwise(best["cut"]).alias("cut"))

    # One pass over the sentences; of two ends as near the earlier one.
    near = F.aggregate("_pieces", none, nearer, lambda best: best["cut"])
    n = F.col("n")
    s = s.withColumn("cut", F.when((F.col("end_ms") - F.col("start_ms") > longest) & (n >= 40), near)).drop("_pieces")
    at = (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col("cut") / n)).cast("long")
    part = lambda k, a, b, t: F.struct(F.lit(k).alias("part"), a.alias("start_ms"), b.alias("end_ms"), t.alias("text"))
    whole = F.array(part(0, F.col("start_ms"), F.col("end_ms"), F.col("text")))
    halves = F.array(part(0, F.col("start_ms"), at, F.trim(F.substring("text", F.lit(1), F.col("cut")))), part(1, at, F.col("end_ms"), F.trim(F.substring("text", F.col("cut") + 1, n))))
    who = [c for c in ("speaker",) if c in segments.columns]
    return s.select("job", "idx", *who, F.explode(F.when(F.col("cut").isNull(), whole).otherwise(halves)).alias("p")).select("job", "idx", *who, "p.*")


def fit_limits(segments: DataFrame, overrides: DataFrame, *, base: float) -> DataFrame:
    """(job, idx, max_stretch, pad_ms): how far each segment's speech may be compressed, and how much earlier it may begin.

    ``overrides`` (job, idx, max_stretch, pad_ms) replace the base, within 1 and 2.5; speech with an emotion in brackets in
    front may take 0.07 more.
    """
    rows = segments.join(overrides.withColumnsRenamed({"max_stretch": "_own", "pad_ms": "_pad"}), ["job", "idx"], "left")
    text = F.regexp_replace(F.coalesce("translated", F.lit("")), r"(?U)^\s+", "")
    felt = F.startswith(text, F.lit("(")) & F.contains(F.left(text, F.lit(30)), F.lit(")"))
    limit = F.when(F.col("_own").isNull(), base).otherwise(F.least(F.greatest(F.col("_own"), F.lit(1.0)), F.lit(2.5)))
    return rows.select("job", "idx", (limit + F.when(felt, 0.07).otherwise(0.0)).alias("max_stretch"), F.greatest(F.coalesce("_pad", F.lit(0)), F.lit(0)).alias("pad_ms"))


def take_longest(clips: DataFrame, *, total: int = 60_000, each: int = 15_000, least: int = 1000) -> DataFrame:
    """Per job and speaker: clips by length, each at most ``each``, until ``total``; parts under ``least`` are left out."""
    w = Window.partitionBy("job", "speaker").orderBy(F.desc("length_ms"), "idx")
    c = clips.withColumn("before", F.coalesce(F.sum(F.least("length_ms", F.lit(each))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("taken_ms", F.least(F.col("length_ms"), F.lit(each), F.lit(total) - F.col("before")))
    return c.where(F.col("taken_ms") >= least).select("job", "speaker", "idx", "taken_ms")
