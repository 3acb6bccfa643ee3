"""Audits: word coverage, stage rows, duplicates, set differences, scoreboards, vectors, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as tx
from cuemill.operators import console


def word_coverage(before: DataFrame, after: DataFrame, *, loss_percent: float = 0.5) -> DataFrame:
    """Per job: words of ``before`` (job, text) that ``after`` lacks, as multisets; severity by the lost share."""
    count = lambda df: df.select("job", F.explode(tx.words(F.col("text"))).alias("w")).groupBy("job", "w").agg(F.count(F.lit(1)).alias("n"))
    a, b = count(before), count(after).withColumnRenamed("n", "m")
    both = a.join(b, ["job", "w"], "left")
    g = both.groupBy("job").agg(F.sum("n").alias("words"), F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("lost"))
    share = F.col("lost") / F.col("words") * 100.0
    return g.withColumns({"lost_pct": share, "severity": F.when(share >= loss_percent, "loss").when(F.col("lost") > 0, "warn").otherwise("info")})


def stage_audit(segments: DataFrame) -> DataFrame:
    """Per stage: rows, distinct ids, words."""
    return segments.groupBy("stage").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("job", "idx").alias("unique_segments"), F.sum(F.size(tx.words(F.col("text")))).alias("words"))


def duplicate_ids(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job", "idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def checklist(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per subject: checks passed (expected and not rejected), total, penalty hits.

    ``rules`` (rule, kind, expect, reject) is a small dimension, joined to every text.
    """
    pairs = texts.crossJoin(rules)
    hit = F.regexp_like("text", "expect") & ~F.coalesce(F.regexp_like("text", "reject"), F.lit(False))
    return pairs.groupBy("subject").agg(F.count_if((F.col("kind") == "check") & hit).alias("passed"), F.count_if(F.col("kind") == "check").alias("total"), F.sum(F.when(F.col("kind") == "penalty", F.regexp_count("text", "expect")).otherwise(0)).alias("penalty_hits"))


def grades(runs: DataFrame) -> DataFrame:
    """Per (model, target): worst of the runs as good, risky or unusable, and the upper median of seconds.

    ``runs`` (model, target, run, segments, fallback, meta, script_ok, digits_kept, seconds, failed).
    """
    g = runs.groupBy("model", "target").agg(
        F.count_if("failed").alias("failed"),
        F.avg("fallback").alias("fallback"),
        F.max("segments").alias("segments"),
        F.avg("meta").alias("meta"),
        F.min("script_ok").alias("script_ok"),
        F.min("digits_kept").alias("digits_kept"),
    )
    middle = console.at_ranks(runs, ["model", "target"], "seconds", {"median_seconds": 0.5}, lambda n, p: F.floor(n / 2))
    g = g.join(middle.drop("n"), ["model", "target"], "left")
    bad = (F.col("failed") > 0) | (F.col("fallback") > F.col("segments") * 0.2) | (F.col("meta") > 0)
    doubtful = (F.col("fallback") > 0) | (F.col("script_ok") < 0.99) | (F.col("digits_kept") < 0.5)
    return g.withColumn("grade", F.when(bad, "unusable").when(doubtful, "risky").otherwise("good")).select("model", "target", "grade", "median_seconds")


def decision_matrix(graded: DataFrame, targets: list[str]) -> DataFrame:
    """One row per model, one column per target."""
    return graded.groupBy("model").pivot("target", targets).agg(F.first("grade"))


def speech_rate(lines: DataFrame, *, anchor: str, longest: int = 8) -> DataFrame:
    """Per language: median characters a second of its longest distinct lines, and the scale against the anchor."""
    once = lines.groupBy("lang", "text").agg(F.min("seconds").alias("seconds"))
    w = Window.partitionBy("lang").orderBy(F.desc(F.length("text")), "text")
    top = once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= longest)
    rates = top.groupBy("lang").agg(F.median(F.length("text") / F.col("seconds")).alias("rate"), F.count(F.lit(1)).alias("samples"))
    base = rates.where(F.col("lang") == anchor).select(F.col("rate").alias("anchor_rate"))
    return rates.crossJoin(F.broadcast(base)).select("lang", "rate", "samples", (F.col("rate") / F.col("anchor_rate")).alias("scale"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; all zeros stay."""
    # As an array's only element the length is found once, not anew for each component.
    over = lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), over), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and unequal lengths."""
    return F.when(F.size(a) == F.size(b), dot(unit(a), unit(b))).otherwise(0.0)


def centroids(vectors: DataFrame, by: str, value: str) -> DataFrame:
    """The mean of each group's unit vectors, component by component (partial sums, no list of a group)."""
    parts = vectors.select(by, F.posexplode(unit(F.col(value))).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    return rows.withColumn("centroid", unit(F.col("centroid")))


def profile_scores(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(vec_id, label, score): the cosine of each vector and each profile's centroid (a few rows), each brought to length one once."""
    ours = vectors.select("vec_id", unit(F.col("embedding")).alias("_u"))
    pairs = ours.crossJoin(F.broadcast(profiles.select("label", unit(F.col("centroid")).alias("_c"))))
    return pairs.select("vec_id", "label", F.when(F.size("_u") == F.size("_c"), dot(F.col("_u"), F.col("_c"))).otherwise(0.0).alias("score"))


def fingerprint(columns: list[Column], required: list[Column], version: str) -> Column:
    """SHA-256 over a versioned JSON of the inputs; null if a required input is empty."""
    value = F.sha2(F.concat(F.lit(version), F.lit("|"), F.to_json(F.struct(*columns))), 256)
    empty = F.lit(False)
    for c in required:
        empty = empty | c.isNull() | (F.length(c.cast("string")) == 0)
    return F.when(~empty, value)


def reuse_plan(stages: DataFrame, wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(job, stage, known, hit): which stages of a job could take a stored artifact with the same fingerprint."""
    have = stored.select("stage", "fingerprint").distinct().withColumn("found", F.lit(True))
    rows = wanted.join(F.broadcast(stages), "stage").join(have, ["stage", "fingerprint"], "left")
    return rows.select("job", "stage", F.col("fingerprint").isNotNull().alias("known"), F.coalesce("found", F.lit(False)).alias("hit"))


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert semantics: the last version of each key (a partial aggregate, no window)."""
    names = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), version).alias("r"))
    return best.select(key, "r.*")


def retain(events: DataFrame, *, now: Column, days: int, newest: int, key: str = "id", at: str = "created") -> DataFrame:
    """Events of the last days, or among the newest ids."""
    top = events.agg(F.max(key).alias("top"))
    rows = events.crossJoin(F.broadcast(top))
    return rows.where((F.col(at) >= now - F.make_dt_interval(F.lit(days))) | (F.col(key) > F.col("top") - newest)).drop("top")
