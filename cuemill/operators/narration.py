"""Subtitle cues of spoken segments: texts halved until each part fits a box of lines, times shared out by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.sources import scratch


def fits_box(text: Column, per_line: int, lines: int) -> Column:
    """Whether words wrap into so many lines; single blanks stand between words."""
    return F.regexp_like(text, F.lit(rf"^(?s:.{{0,{per_line}}})(?: (?s:.{{1,{per_line}}})){{0,{lines - 1}}}$"))


def middle_blank(text: Column) -> Column:
    """Place (from 0) of the blank nearest the middle, the earlier of two as near; null without one."""
    middle = F.floor(F.length(text) / 2).cast("int")
    left = F.length(F.regexp_replace(F.substring(text, F.lit(1), middle + 1), "[^ ]*$", "")) - 1
    ahead = F.instr(F.substring(text, middle + 1, F.length(text)), " ")
    right = F.when(ahead > 0, middle + ahead - 1)
    return F.when((left >= 0) & (right.isNull() | (middle - left <= right - middle)), left).otherwise(right)


def halved(parts: DataFrame, *, per_line: int, lines: int) -> DataFrame:
    """``parts`` (text, at and others) cut at the blank nearest the middle, again and again, until each fits the box or has no blank.

    ``at`` grows by the place of the cut. A round cuts all parts that are too long; there are about as many rounds as a longest
    text has doublings of a box.
    """
    done, rest = [], parts
    others = [c for c in parts.columns if c not in ("text", "at")]
    while True:
        rest = scratch.written(rest.withColumn("cut", F.when(~fits_box(F.col("text"), per_line, lines), middle_blank(F.col("text")))), "parts")
        done.append(rest.where("cut IS NULL").drop("cut"))
        long = rest.where("cut IS NOT NULL")
        if not long.limit(1).count():
            break
        cut = F.col("cut")
        part = lambda start, text: F.struct((F.col("at") + start).alias("at"), text.alias("text"))
        halves = F.array(part(F.lit(0), F.substring("text", F.lit(1), cut)), part(cut + 1, F.substring("text", cut + 2, F.length("text"))))
        rest = long.select(*others, F.inline(halves))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def narration_cues(segments: DataFrame, *, per_line: int = 42, lines: int = 2, gap: int = 120, least: int = 300) -> DataFrame:
    """(job, cue, idx, start_ms, end_ms, text): the cues of segments (job, idx, start_ms, end_ms, text), counted from 0.

    A segment's time is shared between its parts by length, to the millisecond. A cue that ends less than ``gap`` (and one) ms
    ahead of the next one's start is cut short, unless it would last less than ``least`` ms; starts never move.
    Blank and null texts have no cue; a segment that ends before it starts lasts no time.
    """
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    parts = segments.select("job", "idx", "start_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).alias("span"), flat.alias("text"), F.lit(0).alias("at")).where("text != ''")
    cues = halved(parts, per_line=per_line, lines=lines)
    own = Window.partitionBy("job", "idx")
    size = F.length("text")
    cues = cues.withColumns({"total": F.sum(size).over(own), "upto": F.sum(size).over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))})
    moment = lambda n: F.col("start_ms") + F.expr(f"(2 * span * ({n}) + total) div (2 * total)")
    cues = cues.select("job", "idx", "at", "text", moment("upto - length(text)").cast("long").alias("start_ms"), moment("upto").cast("long").alias("end_ms"))
    order = Window.partitionBy("job").orderBy("idx", "at")
    cues = cues.withColumns({"cue": F.row_number().over(order) - 1, "next": F.lead("start_ms").over(order)})
    shaved = F.col("next") - gap - 1
    short = (F.col("next") - F.col("end_ms") < gap + 1) & (shaved - F.col("start_ms") >= least)
    return cues.select("job", "cue", "idx", "start_ms", F.when(short, shaved).otherwise(F.col("end_ms")).alias("end_ms"), "text")
