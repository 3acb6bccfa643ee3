"""Order-dependent passes over a job's segments.

Where a rule only looks at neighbours it is a window over the job. Where it needs what has been built so
far, the segments that may be joined form short runs by such a window, and only a run is folded. Limits are in
milliseconds and characters.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuemill.operators import timeline
from cuemill.sources import scratch

SEGMENT = "job long, idx long, start_ms long, end_ms long, speaker string, text string"


def _in_order():
    return Window.partitionBy("job").orderBy("idx")


def _agree(a: Column, b: Column) -> Column:
    """Speakers that are equal, or one of which isn't known."""
    return F.coalesce((a == b) | (a == "") | (b == ""), F.lit(True))


def _joined(rows: DataFrame) -> DataFrame:
    """Segments of one ``part`` of a ``run`` as one: first begin and speaker, last end, texts in order; numbered anew."""
    parts = rows.groupBy("job", "run", "part").agg(
        F.min("idx").alias("first"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"),
        F.min_by("speaker", "idx").alias("speaker"), F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))).alias("texts"),
    )
    one = F.element_at("texts", 1)["text"]
    several = F.array_join(F.filter(F.transform("texts", lambda x: F.trim(x["text"])), lambda t: t != ""), " ")
    number = F.row_number().over(Window.partitionBy("job").orderBy("first")) - 1
    return parts.select("job", number.cast("long").alias("idx"), "start_ms", "end_ms", "speaker", F.when(F.size("texts") == 1, one).otherwise(several).alias("text"))


def merge_continuations(segments: DataFrame, *, gap: int = 500, longest: int = 12_000, chars: int = 240) -> DataFrame:
    """Segments of one sentence joined: speakers agree, small gap, unfinished (or a gap under 200 ms), within limits.

    Gap and sentence end are those of neighbours; limits and speaker depend on what the joined segment holds
    already. So runs of neighbours that may continue each other are folded.
    """
    before = lambda c: F.lag(c).over(_in_order())
    wait = F.col("start_ms") - before("end_ms")
    open_end = ~F.regexp_like(F.rtrim(F.coalesce(before("text"), F.lit(""))), F.lit("[.!?…][\"'”’)\\]]*$"))
    may = F.coalesce((wait <= gap) & (open_end | (wait < 200)), F.lit(False))
    rows = segments.select("job", "idx", "start_ms", "end_ms", "speaker", "text").withColumn("run", F.sum((~may).cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0)))
    text = F.coalesce("text", F.lit(""))
    member = F.struct("idx", "start_ms", "end_ms", F.coalesce("speaker", F.lit("")).alias("speaker"), F.length(F.trim(text)).alias("n"), F.length(F.rtrim(text)).alias("alone"))
    runs = rows.groupBy("job", "run").agg(F.array_sort(F.collect_list(member)).alias("m"))
    zero = F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("begin"), F.lit("").alias("who"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["part"] >= 0) & _agree(s["who"], x["speaker"]) & (x["end_ms"] - s["begin"] <= longest) & (s["n"] + 1 + x["n"] <= chars)
        part = F.when(fits, s["part"]).otherwise(s["part"] + 1)
        return F.struct(part.alias("part"), F.when(fits, s["begin"]).otherwise(x["start_ms"]).alias("begin"), F.when(fits, s["who"]).otherwise(x["speaker"]).alias("who"), F.when(~fits, x["alone"]).when((s["n"] == 0) | (x["n"] == 0), s["n"] + x["n"]).otherwise(s["n"] + 1 + x["n"]).alias("n"), F.concat(s["parts"], F.array(part)).alias("parts"))

    folded = runs.select("job", "run", "m", F.aggregate("m", zero, step, lambda s: s["parts"]).alias("parts"))
    places = folded.select("job", "run", F.inline(F.arrays_zip(F.col("m.idx").alias("idx"), F.col("parts").alias("part"))))
    return _joined(rows.join(places, ["job", "run", "idx"]))


def absorb_tiny(segments: DataFrame, *, short: int = 1000, chars: int = 40, gap: int = 1500) -> DataFrame:
    """Segments shorter than ``short`` ms and ``chars`` characters go to the one before, else to the one after.

    One pass over a job in order; a segment handed forward is part of the next one, which may be tiny again.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        carried: list | None = None
        items = rows.sort_values("idx")[["start_ms", "end_ms", "speaker", "text"]].to_numpy(dtype=object).tolist()
        near = lambda a, b: (not a[2] or not b[2] or a[2] == b[2]) and b[0] - a[1] < gap
        for k, (start, end, who, text) in enumerate(items):
            now = [start, end, who, text or ""]
            if carried is not None:
                now[0], now[3], carried = carried[0], f"{carried[3].strip()} {now[3].lstrip()}".strip(), None
            if now[1] - now[0] >= short or len(now[3].strip()) >= chars:
                kept.append(now)
            elif kept and near(kept[-1], now):
                kept[-1][1], kept[-1][3] = now[1], f"{kept[-1][3].rstrip()} {now[3].strip()}".strip()
            elif k + 1 < len(items) and near(now, items[k + 1]):
                carried = now
            else:
                kept.append(now)
        return pd.DataFrame([(rows["job"].iloc[0], k, *x) for k, x in enumerate(kept)], columns=["job", "idx", "start_ms", "end_ms", "speaker", "text"])

    return segments.select("job", "idx", "start_ms", "end_ms", "speaker", "text").groupBy("job").applyInPandas(walk, SEGMENT)


def postprocess(segments: DataFrame) -> DataFrame:
    """Joined, absorbed, split where too long, numbered anew from 0."""
    rows = timeline.split_long(absorb_tiny(merge_continuations(segments)))
    number = F.row_number().over(Window.partitionBy("job").orderBy("idx", "part")) - 1
    return rows.select("job", number.cast("long").alias("new"), "start_ms", "end_ms", "speaker", "text").withColumnRenamed("new", "idx")


def layouts(text: str, chars: int, lines: int):
    """Ways to set a text, the preferred one first: words as they fit, whole clauses, balanced lines."""
    words = text.split()

    def fill(pieces: list[str], full) -> list[str]:
        out: list[str] = []
        for p in pieces:
            if out and not full(out, p):
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
        return out

    too_long = lambda out, p: len(out[-1]) + 1 + len(p) > chars
    yield fill(words, too_long)
    clauses = fill(re.split(r"(?<=[.!?;:,])\s+", " ".join(words)), too_long)
    if len(clauses) > 1 and max(map(len, clauses)) <= chars:
        yield clauses
    share = max(1, len(" ".join(words)) // lines)
    yield fill(words, lambda out, p: len(out[-1]) >= share and len(out) < lines)


def rewrap(text: str, chars: int, lines: int) -> str:
    """The first layout of at most ``lines`` lines; the balanced one always is."""
    return "\n".join(next((x for x in layouts(text, chars, lines) if len(x) <= lines), [])) if text.strip() else text


def autofix_cues(cues: DataFrame, *, chars: int = 42, lines: int = 2, cps: float = 17.0, gap: int = 80, most: int = 500) -> DataFrame:
    """(job, idx, end_ms, text): rewrapped, extended into free time for reading speed, shaved for the gap.

    Begins never change, so each step is a window over the next cue. A job's fixes are kept only if its
    violations become strictly fewer.
    """

    @F.pandas_udf(StringType())
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rewrap(t, chars, lines))

    def longest(text: Column) -> Column:
        return F.array_max(F.transform(F.split(text, "\n"), F.length))

    def size(text: Column) -> Column:
        return F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def broken(end: Column, text: Column) -> Column:
        length = end - F.col("start_ms")
        kinds = [longest(text) > chars, F.size(F.split(text, "\n")) > lines, (length > 0) & (size(text) * 1000 / length > cps + 1e-9), F.coalesce(F.col("next") - end < gap, F.lit(False))]
        return sum((k.cast("int") for k in kinds[1:]), kinds[0].cast("int"))

    rows = cues.select("job", "idx", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text")).withColumn("next", F.lead("start_ms").over(_in_order()))
    wide = (longest(F.col("text")) > chars) | (F.size(F.split("text", "\n")) > lines)
    rows = rows.withColumn("set", F.when(wide & (F.trim("text") != ""), wrapped("text")).otherwise(F.col("text")))
    length = F.col("end_ms") - F.col("start_ms")
    wanted = size(F.col("set")) * 1000 / F.lit(cps) - length
    room = F.coalesce(F.col("next") - gap - F.col("end_ms"), F.lit(most))
    grown = F.when((length > 0) & (size(F.col("set")) * 1000 / length > cps), F.greatest(F.lit(0), F.floor(F.least(wanted, room, F.lit(most))))).otherwise(0)
    rows = rows.withColumn("grown", (F.col("end_ms") + grown).cast("long"))
    cut = F.col("next") - gap
    shave = F.coalesce((F.col("next") - F.col("grown") < gap) & (F.col("grown") - cut <= most) & (cut > F.col("start_ms") + 200), F.lit(False))
    rows = rows.withColumn("fixed", F.when(shave, cut).otherwise(F.col("grown")))
    whole = Window.partitionBy("job")
    better = F.sum(broken(F.col("fixed"), F.col("set"))).over(whole) < F.sum(broken(F.col("end_ms"), F.col("text"))).over(whole)
    rows = rows.withColumn("better", better)
    return rows.select("job", "idx", F.when(F.col("better"), F.col("fixed")).otherwise(F.col("end_ms")).alias("end_ms"), F.when(F.col("better"), F.col("set")).otherwise(F.col("text")).alias("text"))


def _in_turns(spans: DataFrame, keys: list[str], turns: list[tuple[Column, int | None]], target: int) -> DataFrame:
    """Spans (keys, start_ms, end_ms, ms) chosen in turns, each turn by length until the target is reached.

    A turn is (which spans, the total that makes it needless). All are running sums over a key.
    """
    group = Window.partitionBy(*keys)
    number = F.when(F.lit(False), 0)
    for k, (which, _) in enumerate(turns):
        number = number.when(which, k)
    rows = spans.withColumn("turn", number).where("turn IS NOT NULL")
    before = group.orderBy(F.desc("ms"), "start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("taken", F.lit(False)).withColumn("total", F.lit(0).cast("long"))
    for k, (_, enough) in enumerate(turns):
        mine = F.col("turn") == k
        needed = F.lit(True) if enough is None else F.col("total") < enough
        so_far = F.col("total") + F.coalesce(F.sum(F.when(mine, F.col("ms"))).over(before), F.lit(0))
        rows = rows.withColumn("taken", F.col("taken") | (mine & needed & (so_far < target)))
        rows = rows.withColumn("total", F.coalesce(F.sum(F.when(F.col("taken"), F.col("ms"))).over(group), F.lit(0)))
    return rows.where("taken").drop("taken", "total", "turn")


def reference_chunks(turns: DataFrame, *, low: int = 1500, high: int = 12_000, target: int = 30_000, least: int = 6_000, cap: int = 15_000) -> DataFrame:
    """(job, speaker, start_ms, end_ms): a voice sample's turns, best lengths first, then short ones, then long ones capped."""
    length = F.col("end_ms") - F.col("start_ms")
    spans = turns.select("job", "speaker", "start_ms", (F.col("start_ms") + F.least(length, F.lit(cap))).alias("end_ms"), length.alias("whole")).withColumn("ms", F.least("whole", F.lit(cap)))
    whole = F.col("whole")
    chosen = _in_turns(spans, ["job", "speaker"], [(whole.between(low, high), None), ((whole >= 400) & (whole < low), least), (whole > high, least)], target)
    return chosen.select("job", "speaker", "start_ms", "end_ms")


def fallback_reference(segments: DataFrame, *, low: int = 1500, high: int = 12_000, target: int = 30_000, least: int = 6_000) -> DataFrame:
    """(job, start_ms, end_ms): a single speaker's sample, from segments with text: good lengths, then whatever has half a second."""
    length = F.col("end_ms") - F.col("start_ms")
    spans = segments.where(F.trim("text") != "").select("job", "start_ms", "end_ms", length.alias("ms"))
    good = F.col("ms").between(low, high)
    return _in_turns(spans, ["job"], [(good, None), (~good & (F.col("ms") >= 500), least)], target).select("job", "start_ms", "end_ms")


def greedy_pairs(scores: DataFrame) -> DataFrame:
    """(grp, a, b, score): one-to-one pairs by descending score within each group; ties by a, then b.

    In rounds over all groups together: a pair that is the best of those that are left both for its a and for its b is one
    that the greedy order takes, so all such pairs are taken at once, and what shares a side with them is left out. Each
    round takes at least the best pair of each group. Repeated pairs count once, with their best score; a null on either
    side or a null score takes no part.

    A group has at most as many pairs as its smaller side has members. So what is better than a taken pair on either of its
    sides, all of it lost to other pairs, is less than that many, and only so many of each side's best pairs go into the rounds.
    """
    spark = scores.sparkSession
    rows = scores.where("a IS NOT NULL AND b IS NOT NULL AND score IS NOT NULL").groupBy("grp", "a", "b").agg(F.max("score").alias("score"))
    # A null group is a group too.
    left = scratch.written(rows.withColumn("g", F.struct("grp")), "pairs")
    taken, order = [], F.struct((-F.col("score")).alias("s"), "a", "b")
    sides = [left.select("g", c).distinct().groupBy("g").agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in "ab"]
    most = sides[0].join(sides[1], "g").agg(F.max(F.least("n_a", "n_b")).alias("n")).first()["n"] or 0
    for side in "ba":
        nth = F.row_number().over(Window.partitionBy("g", side).orderBy(order))
        left = left.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    left = scratch.written(left, "pairs")
    while True:
        by_a = left.groupBy("g", "a").agg(F.min(order).alias("o"))
        by_b = left.groupBy("g", "b").agg(F.min(order).alias("o"))
        both = by_a.select("g", "o").join(by_b.select("g", "o"), ["g", "o"])
        now = scratch.written(both.select("g", F.col("o.a").alias("a"), F.col("o.b").alias("b"), (-F.col("o.s")).alias("score")), "taken")
        if not now.limit(1).count():
            break
        taken.append(now)
        left = scratch.written(left.join(now.select("g", "a"), ["g", "a"], "left_anti").join(now.select("g", "b"), ["g", "b"], "left_anti"), "pairs")
    out = spark.createDataFrame([], left.select("g", "a", "b", "score").schema)
    for now in taken:
        out = out.unionByName(now)
    return out.select("g.grp", "a", "b", "score")


#: Fixed value: how a reply numbers its lines.
NUMBERED = r"^\s*[*#]*\s*[\[(]?(\d{1,3})[\])]?\s*(?:[.):\]|\-]\s*|\s+)\**\s*(.*)$"


def numbered_reply(text: Column, expected: Column) -> Column:
    """The lines 1, 2, 3, ... of a reply, exactly ``expected`` of them and none blank; null for any other reply.

    Only the next number begins a line; what stands between continues the line before, what stands ahead of 1 is dropped.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("over"))

    def step(s: Column, line: Column) -> Column:
        n, last = F.size(s["done"]), F.coalesce(F.try_element_at(s["done"], F.lit(-1)), F.lit(""))
        begins = F.coalesce(F.nullif(F.regexp_extract(line, NUMBERED, 1), F.lit("")).cast("int"), F.lit(-1)) == n + 1
        more = F.concat(s["done"], F.array(F.trim(F.regexp_extract(line, NUMBERED, 2))))
        longer = F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.trim(F.concat_ws(" ", last, F.trim(line)))))
        done = F.when(begins & (n < expected), more).when(~begins & (n > 0) & (F.trim(line) != ""), longer).otherwise(s["done"])
        return F.struct(done.alias("done"), (s["over"] | (begins & (n >= expected))).alias("over"))

    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    right = lambda s: F.when(~s["over"] & (F.size(s["done"]) == expected) & F.forall(s["done"], lambda x: x != ""), s["done"])
    return F.aggregate(lines, zero, step, right)
