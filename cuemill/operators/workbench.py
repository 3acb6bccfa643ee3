"""Job records and editing: histories, attempts, gates, notices, casting, overrides, plans, deliveries.

Windows are partitioned by job, batch or stage. Running totals over all jobs go through totals per bucket,
so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.operators import metering


def newest(rows: DataFrame, key: str, order: list[str], keep: int) -> DataFrame:
    """The last ``keep`` rows of each key, with ``nth`` (1 is the newest): error histories, notes, attempts."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep)


def attempts(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Runs with their attempt number per key and whether they are the latest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumns({"attempt": F.row_number().over(w), "latest": F.lead(F.lit(1)).over(w).isNull()})


def upstream(stages: DataFrame, key: str, nth: str, present: Column) -> DataFrame:
    """Each stage with the nearest earlier one that has a checkpoint (null if there is none)."""
    w = Window.partitionBy(key).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("upstream", F.last(F.when(present, F.col(nth)), ignorenulls=True).over(w))


def speaker_rows(segments: DataFrame) -> DataFrame:
    """Per job and speaker: lines, their share of the job, and the line of middle length (the upper of two)."""
    w = Window.partitionBy("job", "speaker")
    ranked = segments.withColumns({"at": F.row_number().over(w.orderBy(F.length("text"), "idx")) - 1, "lines": F.count(F.lit(1)).over(w)})
    rows = ranked.groupBy("job", "speaker").agg(F.max("lines").alias("lines"), F.max(F.when(F.col("at") == F.floor(F.col("lines") / 2), F.col("idx"))).alias("sample_idx"))
    return rows.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy("job")))


def edit_speakers(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with new speakers: ``edits`` (speaker, becomes) is a small table; null removes speech, indices stay."""
    found = segments.join(edits.withColumn("edited", F.lit(True)), "speaker", "left")
    return found.select("job", "idx", F.when(F.col("edited"), F.col("becomes")).otherwise(F.col("speaker")).alias("speaker"), (F.coalesce("edited", F.lit(False)) & F.col("becomes").isNull()).alias("non_speech"))


def sync_plan(placed: DataFrame, *, tolerance: float = 1.05, most: float = 1.4) -> DataFrame:
    """(job, idx, max_stretch): rows beyond the tolerance that close under the cap."""
    stretch = F.col("dub_ms") / (F.col("end_ms") - F.col("start_ms"))
    rows = placed.where("end_ms > start_ms").withColumn("max_stretch", stretch)
    return rows.where((F.col("max_stretch") > tolerance) & (F.col("max_stretch") <= most)).select("job", "idx", "max_stretch")


def override_cues(cues: DataFrame, overrides: DataFrame, *, most: int = 500) -> DataFrame:
    """Cues with ``overrides`` (job, idx, delta_start, delta_end) added, each within plus or minus ``most`` ms."""
    clip = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c))))
    rows = cues.join(overrides, ["job", "idx"], "left")
    return rows.select("job", "idx", (F.col("start_ms") + clip("delta_start")).alias("start_ms"), (F.col("end_ms") + clip("delta_end")).alias("end_ms"))


def slide_spans(slides: DataFrame) -> DataFrame:
    """(job, image, start_ms, end_ms): a slide without a picture keeps the one before; equal neighbours are one span."""
    w = Window.partitionBy("job").orderBy("idx")
    s = slides.withColumn("shown", F.last("image", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("shown IS NOT NULL")
    s = s.withColumn("fresh", F.coalesce((F.lag("shown").over(w) != F.col("shown")).cast("int"), F.lit(1)))
    s = s.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("job", "run").agg(F.first("shown").alias("image"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


def merge_notices(notices: DataFrame, key: str) -> DataFrame:
    """One notice per key and code: the worst severity; of equal ones the later."""
    best = F.struct(-scalars.severity_rank(F.col("severity")), F.col("pos"))
    return notices.groupBy(key, "code").agg(F.max_by(F.struct("severity", "pos"), best).alias("n"), F.count(F.lit(1)).alias("times")).select(key, "code", "n.severity", "n.pos", "times")


def first_gate(states: DataFrame, gates: DataFrame) -> DataFrame:
    """Per job the first armed gate at or before its stage that isn't cleared; none, if all are.

    ``states`` (job, nth), ``gates`` (job, gate, at, armed, cleared, findings). Unknown findings pause; none pass.
    """
    stop = gates.where("armed AND NOT cleared AND (findings IS NULL OR findings > 0)")
    hit = states.join(stop, "job").where(F.col("at") <= F.col("nth"))
    return states.join(hit.groupBy("job").agg(F.min_by("gate", F.struct("at", "gate")).alias("gate")), "job", "left").select("job", "nth", "gate")


def running_total(rows: DataFrame, bucket: Column, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all rows of earlier buckets and of this one's earlier rows."""
    rows = rows.withColumn("bucket", bucket)
    days = rows.groupBy("bucket").agg(F.sum(value).alias("all"))
    # One row per bucket.
    earlier = days.select("bucket", F.coalesce(F.sum("all").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(earlier, "bucket").withColumn("before", F.col("earlier") + F.col("within")).drop("bucket", "earlier", "within")


def job_costs(jobs: DataFrame) -> DataFrame:
    """(id, minutes, cost): what each job costs at its position in the running volume, by creation time."""
    m = running_total(metering.metered(jobs), F.date_format("created", "yyyy-MM-dd HH"), ["created", "id"], "billable")
    before, own = F.col("before").cast("double"), F.col("billable").cast("double")
    return m.select("id", own.alias("minutes"), (metering.price(before + own) - metering.price(before)).alias("cost"))


def month_to_date(jobs: DataFrame, *, now: str) -> DataFrame:
    """One row: minutes, cost and rate of the calendar month so far."""
    at = F.lit(now).cast("timestamp")
    m = metering.metered(jobs).where((F.col("created") >= F.date_trunc("month", at)) & (F.col("created") <= at))
    total = m.agg(F.coalesce(F.sum("billable"), F.lit(0)).cast("double").alias("minutes"), F.count_if(F.col("billable") > 0).alias("jobs"))
    return total.withColumns({"cost": metering.price(F.col("minutes")), "rate": metering.marginal_rate(F.col("minutes"))})


def cleanup(jobs: DataFrame, *, now: str, days: int, errored: bool = False, cancelled: bool = False) -> DataFrame:
    """Jobs that a cleanup would remove (a report; nothing is removed): finished and older than ``days``."""
    states = ["done", *(["failed"] if errored else []), *(["cancelled"] if cancelled else [])]
    old = F.col("created") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return jobs.where(scalars.state(F.col("status")).isin(states) & old)


def breaker(outcomes: DataFrame, key: str, order: str, *, limit: int = 3) -> DataFrame:
    """Outcomes (key, order, failed) with the failures in a row so far and whether the breaker is open after them."""
    w = Window.partitionBy(key).orderBy(order)
    rows = outcomes.withColumn("island", F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "island").orderBy(order)
    rows = rows.withColumn("in_a_row", F.sum(F.col("failed").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("open", F.col("in_a_row") >= limit).drop("island")


def budget_multiplier(outcomes: DataFrame, key: str, order: str, *, step: int = 4, most: int = 16) -> DataFrame:
    """Outcomes (key, order, starved) with the multiplier that the next request gets: ``step`` times more after each starved one, at most ``most``."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    times = F.sum(F.col("starved").cast("int")).over(so_far)
    return outcomes.withColumn("multiplier", F.least(F.pow(F.lit(float(step)), F.least(times, F.lit(30))), F.lit(float(most))).cast("long"))


def suffixed(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Ids made unique: the second of a base gets -2, the third -3."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("unique_id", F.when(nth == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))))


def around(log: DataFrame, key: str, failures: DataFrame, *, before: int = 20, after: int = 5) -> DataFrame:
    """Log rows (key, seq) from ``before`` rows ahead of each failure (key, at) to ``after`` rows behind it.

    Failures are marked in the log; a row belongs to the failures among the rows around it, so one window finds
    them all, however far apart sequence numbers are.
    """
    marks = failures.groupBy(key, F.col("at").alias("seq")).agg(F.first("at").alias("at"))
    w = Window.partitionBy(key).orderBy("seq")
    rows = log.join(marks, [key, "seq"], "left").withColumn("near", F.collect_list("at").over(w.rowsBetween(-after, before - 1)))
    return rows.drop("at").withColumn("at", F.explode("near")).drop("near")


def glossary_for(domains: DataFrame, language: str) -> DataFrame:
    """(term, dst, say): a glossary's terms for one language; of several domains the last that has a value decides.

    ``domains`` (pos, target_lang, term, dst, say) in their order ``pos``. A domain without a language is for all; without a
    language asked for, all domains count. Translations keep their blanks, respellings and their terms lose them.
    """
    asked = F.lit(language.strip().lower()[:2])
    own = F.left(F.lower(F.trim(F.coalesce("target_lang", F.lit("")))), F.lit(2))
    rows = domains.where((own == "") | (asked == "") | (own == asked))
    said = rows.where("trim(dst) != ''").groupBy("term").agg(F.max_by("dst", "pos").alias("dst"))
    spoken = rows.where("trim(say) != '' AND trim(term) != ''").groupBy(F.trim("term").alias("term")).agg(F.max_by(F.trim("say"), "pos").alias("say"))
    return said.join(spoken, "term", "full").where("term IS NOT NULL").select("term", "dst", "say")


def merge_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """A glossary (term, dst, say) with new entries; a field that the new entry lacks keeps its old value."""
    a, b = old.select("term", F.col("dst").alias("d0"), F.col("say").alias("s0")), new.select("term", F.col("dst").alias("d1"), F.col("say").alias("s1"))
    return a.join(b, "term", "full").select("term", F.coalesce("d1", "d0").alias("dst"), F.coalesce("s1", "s0").alias("say"))


def split_cues(cues: DataFrame, *, chars: int = 42) -> DataFrame:
    """(job, idx, part, start_ms, end_ms): cues cut into pieces of about ``chars``, time shared out by length."""
    n = F.length("text")
    parts = F.greatest(F.ceil(n / chars), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(k.alias("part"), F.floor(n * k / parts).alias("a"), F.floor(n * (k + 1) / parts).alias("b")))
    rows = cues.select("job", "idx", "start_ms", "end_ms", n.alias("n"), F.explode(pieces).alias("p"))
    at = lambda c: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * F.col(c) / F.greatest(F.col("n"), F.lit(1)))).cast("long")
    return rows.select("job", "idx", F.col("p.part").alias("part"), at("p.a").alias("start_ms"), F.when(F.col("n") == 0, F.col("end_ms")).otherwise(at("p.b")).alias("end_ms"))


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of a text's UTF-8 bytes, in built-in expressions."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in block)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in block)), F.unhex(inner)), 256)


def deliveries(events: DataFrame, hooks: DataFrame, *, kind: str = "event_type") -> DataFrame:
    """Each event for each enabled hook that subscribes to its kind, once."""
    wanted = hooks.where("enabled").withColumn(kind, F.explode(F.array_distinct("events")))
    return events.join(wanted, kind)


def loudness(log: Column) -> Column:
    """(i, tp, lra) of the last JSON block with ``input_i`` in a log; "-inf" is null."""
    last = F.try_element_at(F.filter(F.regexp_extract_all(log, F.lit(r"(?s)\{[^{}]*\}"), 0), lambda b: F.contains(b, F.lit('"input_i"'))), F.lit(-1))
    j = F.from_json(last, "input_i string, input_tp string, input_lra string")
    return F.struct(scalars.finite(j["input_i"]).alias("i"), scalars.finite(j["input_tp"]).alias("tp"), scalars.finite(j["input_lra"]).alias("lra"))
