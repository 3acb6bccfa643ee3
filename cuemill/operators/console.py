"""The operator's console: attention list, stage health, fleet, review queue, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.operators import metering

#: Samples that a comparison needs, ratios that warn, and the anomaly rule.
LEAST_RECENT, LEAST_BASELINE, WARN_RATIO, BAD_RATIO = 4, 8, 1.5, 3.0
ANOMALY_RATIO, ANOMALY_MINUTES = 3.0, 30.0


#: Groups up to this size are ranked whole; of larger ones only the values within ``MARGIN`` of a share.
SMALL, MARGIN = 10_000, 1e-3


def at_ranks(values: DataFrame, by: list[str], value: str, shares: dict[str, float], place) -> DataFrame:
    """(by, n, a column for each share): exact order statistics, interpolated between neighbours.

    ``place(n, share)`` is the position from 0, perhaps between two. A mergeable sketch brackets each share
    first, with an error of a tenth of ``MARGIN``; values below the bracket are only counted, those in it are counted by
    value and summed up in order. So no task sorts a whole group, and no group is a list or a map.
    """
    same = lambda left, right: F.lit(True) if not by else [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    points = [x for p in shares.values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sizes = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*[F.lit(x) for x in points]), F.lit(10_000)).alias("_q"))
    rows = v.alias("a").join(sizes.alias("b"), same("a", "b")).select("a.*", "b.n", "b._q")
    whole = F.col("n") <= SMALL
    below = [(~whole & (F.col("_v") < F.col("_q")[2 * k])).alias(f"_b{k}") for k in range(len(shares))]
    inside = [F.when(whole | F.col("_v").between(F.col("_q")[2 * k], F.col("_q")[2 * k + 1]), F.lit(k)) for k in range(len(shares))]
    under = rows.select(*by, "n", *below).groupBy(*by, "n").agg(F.array(*[F.count_if(f"_b{k}") for k in range(len(shares))]).alias("_under"))
    near = rows.select(*by, "_v", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("_k")).groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = near.alias("a").join(under.alias("b"), same("a", "b")).select("a.*", "b.n", "b._under")
    ends = F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_under")[F.col("_k")]
    near = near.withColumn("_to", ends)
    spot = F.when(F.lit(False), F.lit(0.0))
    for k, p in enumerate(shares.values()):
        spot = spot.when(F.col("_k") == k, place(F.col("n"), F.lit(p)).cast("double"))
    near = near.withColumn("_r", spot)
    covers = lambda r: (F.col("_to") - F.col("_c") <= r) & (r < F.col("_to"))
    low, high = F.floor("_r"), F.least(F.floor("_r") + 1, F.col("n") - 1)
    found = near.groupBy(*by, "n", "_k", "_r").agg(F.max(F.when(covers(low), F.col("_v"))).alias("_x"), F.max(F.when(covers(high), F.col("_v"))).alias("_y"))
    part = F.col("_r") - F.floor("_r")
    found = found.withColumn("_z", F.when(part == 0, F.col("_x")).otherwise((1 - part) * F.col("_x") + part * F.col("_y")))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_k") == k, F.col("_z"))).alias(name) for k, name in enumerate(shares)])


def _nearest(n, p):
    return F.greatest(F.ceil(n * p) - 1, F.lit(0))


def nearest_rank(values: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group, and how many values there are; groups without values have none."""
    found = at_ranks(values, [by], value, shares, _nearest).withColumnsRenamed({"n": "samples", by: "_by"})
    every = values.select(by).distinct()
    rows = every.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    return rows.select(by, *shares, F.coalesce("samples", F.lit(0)).alias("samples"))


def linear_percentiles(values: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    return at_ranks(values, [by], value, shares, lambda n, p: (n - 1) * p).drop("n")


def upper_median(values: DataFrame, by: str, value: str) -> DataFrame:
    """The element at half the count of the sorted values."""
    return at_ranks(values, [by], value, {"upper_median": 0.5}, lambda n, p: F.floor(n / 2)).drop("n")


def most_common_error(jobs: DataFrame, *, chars: int = 80) -> DataFrame:
    """The most common first line of failed jobs' errors; of equal counts the one seen first."""
    failed = jobs.where(scalars.state(F.col("status")) == "failed")
    line = F.left(F.split(F.coalesce("error", F.lit("unknown")), "\n")[0], F.lit(chars))
    counts = failed.groupBy(line.alias("reason")).agg(F.count(F.lit(1)).alias("jobs"), F.min("id").alias("first_id"))
    return counts.orderBy(F.desc("jobs"), "first_id").limit(1)


def stage_health(samples: DataFrame) -> DataFrame:
    """``samples`` (stage, rate, recent boolean): p50 and p95 against the baseline's p95, and a severity."""
    found = at_ranks(samples, ["stage", "recent"], "rate", {"p50": 0.5, "p95": 0.95}, _nearest)
    side = lambda name, recent: F.max(F.when(F.col("recent") == recent, F.col(name)))
    count = lambda recent: F.coalesce(side("n", recent), F.lit(0))
    some = samples.select("stage").distinct()
    g = found.groupBy("stage").agg(count(True).alias("runs"), count(False).alias("baseline_runs"), side("p50", True).alias("p50"), side("p95", True).alias("p95"), side("p95", False).alias("baseline_p95"))
    g = some.join(g, "stage", "left").fillna(0, ["runs", "baseline_runs"])
    zero = F.lit(0.0)
    g = g.withColumns({c: F.coalesce(c, zero) for c in ("p50", "p95", "baseline_p95")})
    enough = (F.col("runs") >= LEAST_RECENT) & (F.col("baseline_runs") >= LEAST_BASELINE) & (F.col("baseline_p95") > 0)
    g = g.withColumn("ratio", F.when(enough, F.col("p95") / F.col("baseline_p95")))
    return g.withColumn("severity", F.when(F.col("ratio") >= BAD_RATIO, "bad").when(F.col("ratio") >= WARN_RATIO, "warn").otherwise("ok"))


def stage_alerts(health: DataFrame) -> DataFrame:
    return health.where(F.col("severity").isin("warn", "bad")).orderBy(F.desc("ratio"), "stage")


def key_issues(keys: DataFrame, *, now: str) -> DataFrame:
    """Credential hygiene: expired but live, about to expire, old without an end."""
    t = F.lit(now).cast("timestamp")
    week, stale = F.expr("INTERVAL 7 DAYS"), F.expr("INTERVAL 180 DAYS")
    kind = F.when(F.col("expires") < t, "expired").when(F.col("expires") < t + week, "expiring").when(F.col("expires").isNull() & (F.col("created") < t - stale), "stale")
    rows = keys.where(~F.coalesce("revoked", F.lit(False))).withColumn("issue", kind).where("issue IS NOT NULL")
    return rows.select("key_id", "issue", F.when(F.col("issue") == "expired", "bad").otherwise("warn").alias("severity"))


def attention(jobs: DataFrame, keys: DataFrame, alerts: DataFrame, *, now: str) -> DataFrame:
    """What needs a person, worst first: failures, paused and stale jobs, slow stages, credentials."""
    t = F.lit(now).cast("timestamp")
    day, week = F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 7 DAYS")
    s = jobs.withColumn("state", scalars.state(F.col("status")))
    kind = F.when((F.col("state") == "failed") & (F.col("created") >= t - week), "failed").when(F.col("state") == "attention", "paused").when((F.col("state") == "active") & (F.col("created") < t - day), "stale")
    groups = s.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").cast("string").alias("target"))
    groups = groups.withColumn("severity", F.when(F.col("kind") == "failed", "bad").otherwise("warn"))
    slow = alerts.select(F.lit("slow stage").alias("kind"), F.col("runs").alias("n"), F.col("stage").alias("target"), "severity")
    issues = key_issues(keys, now=now).select(F.concat(F.lit("key "), "issue").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("key_id").cast("string").alias("target"), "severity")
    rows = groups.select("kind", "n", "target", "severity").unionByName(slow).unionByName(issues)
    return rows.orderBy(scalars.severity_rank(F.col("severity")), "kind", "target")


def overview_tiles(jobs: DataFrame, *, since: str, middle: str, now: str) -> DataFrame:
    """Five tiles with the change against the window of equal length before."""
    counts = metering.window_counts(jobs, [("current", middle, now), ("previous", since, middle)])
    values = {"revenue": "cost", "minutes": "minutes", "jobs": "jobs", "success": "success_pct"}
    pick = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c).cast("double")))
    wide = counts.agg(*[pick(c, p).alias(f"{n}_{p}") for n, c in values.items() for p in ("current", "previous")])
    tiles = F.array(*[F.struct(F.lit(n).alias("tile"), F.col(f"{n}_current").alias("value"), F.coalesce(f"{n}_previous", F.lit(0.0)).alias("before")) for n in values])
    rows = wide.select(F.explode(tiles).alias("t")).select("t.*")
    return rows.select("tile", "value", scalars.percent_delta(F.coalesce("value", F.lit(0.0)), F.col("before")).alias("delta_pct"))


def usage_anomaly(jobs: DataFrame, *, since: str, now: str) -> DataFrame:
    """The last bucket against the upper median of all earlier ones; a row if it is well above."""
    series = metering.usage_series(jobs, since=since, until=now)
    last = series.agg(F.max("bucket").alias("last"))
    s = series.crossJoin(F.broadcast(last))
    # At most the window's days.
    rest = s.where("bucket < last").agg(F.sort_array(F.collect_list("minutes")).alias("m"))
    rows = s.where("bucket = last").crossJoin(rest).select("bucket", "minutes", F.col("m")[F.floor(F.size("m") / 2).cast("int")].alias("median"), (F.size("m") + 1).alias("buckets"))
    hit = (F.col("buckets") >= 8) & (F.col("minutes") >= ANOMALY_MINUTES) & (F.col("median") > 0) & (F.col("minutes") / F.col("median") >= ANOMALY_RATIO)
    return rows.withColumn("anomaly", hit)


def fleet(jobs: DataFrame, *, now: str) -> DataFrame:
    """One row: running, share of failures in the last day, its top cause, status."""
    t = F.lit(now).cast("timestamp")
    s = jobs.withColumn("state", scalars.state(F.col("status")))
    recent = F.col("created") >= t - F.expr("INTERVAL 1 DAY")
    sums = s.agg(F.count_if(F.col("state") == "active").alias("running"), F.count_if(recent & (F.col("state") == "done")).alias("done"), F.count_if(recent & (F.col("state") == "failed")).alias("failed"))
    top = most_common_error(jobs.where(recent), chars=60).select(F.col("reason").alias("top_cause"))
    graded = F.col("done") + F.col("failed")
    rows = sums.join(top, F.lit(True), "left").withColumn("fail_pct", F.when(graded > 0, F.col("failed") / graded * 100.0))
    return rows.withColumn("status", F.when(F.col("fail_pct") > 10, "warn").otherwise("ok"))
