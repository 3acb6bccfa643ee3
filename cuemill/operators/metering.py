"""Usage metering: billable minutes, cumulative tiers, series, allocation, exposure.

All functions take jobs (``created`` timestamp, ``status``, ``minutes`` of source, ``n_langs`` ...) and explicit window
bounds. Money stays unrounded. Group keys are pre-aggregated on the map side; windows run over buckets,
never over jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars

#: Fixed values of the price schedule: (from, to, rate per minute), surcharge per showcase minute, storage.
TIERS = [(0.0, 500.0, 0.080), (500.0, 2000.0, 0.065), (2000.0, None, 0.050)]
SHOWCASE_RATE = 0.020
STORAGE_INCLUDED_GB, STORAGE_RATE = 100.0, 0.02


def billable(status: Column, minutes: Column, n_langs: Column) -> Column:
    """Source minutes times target languages; nothing for failed or cancelled jobs or without a duration."""
    whole = minutes * F.greatest(F.coalesce(n_langs, F.lit(1)), F.lit(1))
    return F.when(status.isin(scalars.UNBILLED) | minutes.isNull() | (minutes <= 0), 0).otherwise(whole).cast("decimal(18,3)")


def band_minutes(total: Column, lower: float, upper: float | None) -> Column:
    room = total - lower
    return F.greatest(F.lit(0.0), room if upper is None else F.least(room, F.lit(upper - lower)))


def price(total: Column) -> Column:
    """Cost of ``total`` minutes (a double) under the cumulative tiers."""
    out = F.lit(0.0)
    for lower, upper, rate in TIERS:
        out = out + band_minutes(total, lower, upper) * F.lit(rate)
    return out


def marginal_rate(total: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for _, upper, rate in TIERS[:-1]:
        out = out.when(total < upper, rate)
    return out.otherwise(TIERS[-1][2])


def minutes_to_next_tier(total: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for _, upper, _ in TIERS[:-1]:
        out = out.when(total < upper, F.lit(upper) - total)
    return out


def tier_bands(totals: DataFrame, total: str = "minutes") -> DataFrame:
    """One row per tier and row of ``totals``: all bands, reached or not."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(lo).alias("from_minutes"), F.lit(up).cast("double").alias("to_minutes"), F.lit(r).alias("rate"), band_minutes(F.col(total), lo, up).alias("used")) for i, (lo, up, r) in enumerate(TIERS)])
    rows = totals.withColumn("b", F.explode(bands)).select("*", "b.*").drop("b")
    return rows.withColumns({"cost": F.col("used") * F.col("rate"), "reached": F.col(total) > F.col("from_minutes")})


def metered(jobs: DataFrame) -> DataFrame:
    """Jobs with ``billable`` minutes and ``state``."""
    return jobs.withColumns({"billable": billable(F.col("status"), F.col("minutes"), F.col("n_langs")), "state": scalars.state(F.col("status"))})


def in_window(created: Column, since: Column, until: Column) -> Column:
    return (created >= since) & (created < until)


def usage_series(jobs: DataFrame, *, since: str, until: str, bucket: str = "day") -> DataFrame:
    """Minutes, jobs and marginal cost per day or month, quiet ones too.

    A bucket costs the difference of the prices of the running totals after and before it, so the costs sum
    to the price of the whole window.
    """
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    pattern = "yyyy-MM" if bucket == "month" else "yyyy-MM-dd"
    days = F.explode(F.sequence(lo, hi - F.expr("INTERVAL 1 SECOND"), F.expr("INTERVAL 1 DAY")))
    one = jobs.sparkSession.range(1)
    seeds = one.select(days.alias("t")).union(one.select((hi - F.expr("INTERVAL 1 SECOND")).alias("t"))).select(F.date_format("t", pattern).alias("bucket")).distinct()
    used = metered(jobs).where(in_window(F.col("created"), lo, hi)).groupBy(F.date_format("created", pattern).alias("bucket")).agg(F.sum("billable").alias("m"), F.count(F.lit(1)).alias("jobs"))
    rows = seeds.join(used, "bucket", "left").select("bucket", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("jobs", F.lit(0)).alias("jobs"))
    # One row per bucket: this window holds days, not jobs.
    total = F.sum("m").over(Window.orderBy("bucket")).cast("double")
    rows = rows.withColumn("total", total)
    cost = price(F.col("total")) - price(F.coalesce(F.lag("total").over(Window.orderBy("bucket")), F.lit(0.0)))
    return rows.select("bucket", F.col("m").cast("double").alias("minutes"), "jobs", cost.alias("cost"))


def usage_summary(jobs: DataFrame, *, since: str, storage_gb: float = 0.0) -> DataFrame:
    """One row: minutes, jobs counted and unbilled, showcase minutes, rate, distance to the next tier, cost."""
    m = metered(jobs).where(F.col("created") >= F.lit(since).cast("timestamp"))
    paid = F.col("billable") > 0
    sums = m.agg(
        F.coalesce(F.sum("billable"), F.lit(0)).cast("double").alias("minutes"),
        F.count_if(paid).alias("jobs_counted"),
        F.count_if(~paid & F.col("status").isin(scalars.UNBILLED)).alias("jobs_unbilled"),
        F.coalesce(F.sum(F.when(F.col("batch_kind") == "showcase", F.col("billable"))), F.lit(0)).cast("double").alias("showcase_minutes"),
    )
    storage = max(0.0, storage_gb - STORAGE_INCLUDED_GB) * STORAGE_RATE
    total = F.col("minutes")
    return sums.withColumns(
        {
            "rate": marginal_rate(total),
            "next_tier_minutes": minutes_to_next_tier(total),
            "showcase_surcharge": F.col("showcase_minutes") * F.lit(SHOWCASE_RATE),
            "storage_cost": F.lit(storage),
            "cost": price(total) + F.col("showcase_minutes") * F.lit(SHOWCASE_RATE) + F.lit(storage),
        }
    )


def usage_by_language(jobs: DataFrame, *, since: str) -> DataFrame:
    m = metered(jobs).where((F.col("created") >= F.lit(since).cast("timestamp")) & (F.col("billable") > 0))
    return m.groupBy(F.coalesce("target_lang", F.lit("?")).alias("target_lang")).agg(F.sum("billable").cast("double").alias("minutes"))


def marginal_cost(quotes: DataFrame, used: str = "used_minutes", new: str = "new_minutes") -> DataFrame:
    """What ``new`` minutes cost on top of ``used`` ones: a difference of two cumulative prices."""
    u, n = F.greatest(F.coalesce(used, F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(new, F.lit(0.0)), F.lit(0.0))
    out = quotes.withColumn("cost", price(u + n) - price(u)).withColumn("rate", marginal_rate(u))
    return out.withColumns({"total_cost": price(u + n), "effective_rate": F.when(n > 0, F.col("cost") / n).otherwise(F.col("rate"))})


def top_sources(jobs: DataFrame, *, since: str, until: str, limit: int = 10) -> DataFrame:
    """The batches with most minutes; the window's cost is shared out by minutes."""
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    m = metered(jobs).where(in_window(F.col("created"), lo, hi)).withColumn("batch", F.coalesce(F.col("batch_id"), F.col("id")))
    rank = scalars.severity_rank(scalars.severity(F.col("state")))
    groups = m.groupBy("batch").agg(
        F.sum("billable").alias("m"),
        F.count(F.lit(1)).alias("jobs"),
        F.array_join(F.array_sort(F.collect_set(F.lower("target_lang"))), ",").alias("langs"),
        F.min(rank).alias("worst"),
        F.bool_or(F.col("batch_kind") == "showcase").alias("showcase"),
    )
    # The total is one row; joining it keeps the groups distributed.
    total = groups.agg(F.sum("m").cast("double").alias("all"))
    rows = groups.crossJoin(F.broadcast(total))
    minutes = F.col("m").cast("double")
    cost = F.when(F.col("all") > 0, price(F.col("all")) * (minutes / F.col("all"))).otherwise(0.0)
    rows = rows.select(
        "batch",
        "jobs",
        "langs",
        minutes.alias("minutes"),
        cost.alias("cost"),
        F.when(minutes > 0, cost / minutes).otherwise(0.0).alias("effective_rate"),
        F.when(F.col("showcase"), "showcase").when(F.col("jobs") > 1, "multi-language").otherwise("single").alias("mode"),
        F.when(F.col("worst") == 0, "bad").when(F.col("worst") == 1, "warn").otherwise("ok").alias("health"),
    )
    return rows.orderBy(F.desc("minutes"), "batch").limit(limit)


def window_counts(jobs: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """One row per named window (name, since, until): jobs per state, minutes, cost, success share."""
    m = metered(jobs)
    name = F.when(F.lit(False), "")
    for label, since, until in windows:
        name = name.when(in_window(F.col("created"), F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")), label)
    counts = m.withColumn("period", name).where("period IS NOT NULL").groupBy("period").agg(
        F.sum("billable").cast("double").alias("minutes"),
        F.count(F.lit(1)).alias("jobs"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "cancelled", "attention", "active")],
    )
    graded = F.col("done") + F.col("failed")
    return counts.withColumns({"cost": price(F.col("minutes")), "success_pct": F.when(graded > 0, F.col("done") / graded * 100.0)})


def unbilled_exposure(jobs: DataFrame, *, since: str, until: str) -> DataFrame:
    """Minutes of running, paused and failed work, which will not turn into money (languages don't multiply here)."""
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    m = metered(jobs).where(in_window(F.col("created"), lo, hi) & F.col("state").isin("active", "attention", "failed"))
    label = F.when(F.col("state") == "active", "in flight").when(F.col("state") == "attention", "paused for review").otherwise("failed, never billed")
    rows = m.groupBy(label.alias("label"), scalars.severity(F.col("state")).alias("severity")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("minutes").cast("double").alias("minutes"))
    return rows.withColumn("cost", price(F.col("minutes")))


def unbilled_examples(jobs: DataFrame, *, since: str, until: str, limit: int = 8) -> DataFrame:
    """The first jobs of each unbilled state by id."""
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    m = metered(jobs).where(in_window(F.col("created"), lo, hi) & F.col("state").isin("active", "attention", "failed"))
    rows = m.withColumn("nth", F.row_number().over(Window.partitionBy("state").orderBy("id"))).where(F.col("nth") <= limit)
    return rows.select("state", "nth", "id", "target_lang", "status", F.col("minutes").cast("double").alias("minutes"), F.left(F.coalesce("error", F.lit("")), F.lit(120)).alias("error"))


def export_rows(jobs: DataFrame, *, since: str, until: str) -> DataFrame:
    """One row per job for a CSV file: ISO time, minutes and share of the window's cost."""
    lo, hi = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    m = metered(jobs).where(in_window(F.col("created"), lo, hi))
    total = m.agg(F.sum("billable").cast("double").alias("all"))
    rows = m.crossJoin(F.broadcast(total))
    minutes = F.col("billable").cast("double")
    return rows.select("id", scalars.iso_seconds(F.col("created")).alias("created"), "target_lang", "status", minutes.alias("minutes"), F.when(F.col("all") > 0, price(F.col("all")) * (minutes / F.col("all"))).otherwise(0.0).alias("cost"))


def realtime_factor(jobs: DataFrame, *, least: int = 3) -> DataFrame:
    """Median wall clock per second of source over complete jobs; null below ``least`` plausible samples."""
    ok = jobs.where((F.col("status") == "complete") & F.col("factor").between(0.05, 200.0))
    return ok.agg(F.count(F.lit(1)).alias("samples"), F.median("factor").alias("m")).select("samples", F.when(F.col("samples") >= least, F.col("m")).alias("factor"))
