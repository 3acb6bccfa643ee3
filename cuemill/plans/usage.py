"""Queries of metering and the console over ``events``, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.operators import console, metering
from cuemill.sources.standin import JOBS_SQL, NOW, jobs, table

SINCE, MIDDLE, EARLY = "2024-01-11 00:00:00", "2024-01-16 00:00:00", "2024-01-01 00:00:00"
LATE = "2024-02-04 00:00:00"


def _price(x: str) -> str:
    return f"(0.0::DOUBLE + greatest(0.0, least({x} - 0.0, 500.0))::DOUBLE * 0.08::DOUBLE + greatest(0.0, least({x} - 500.0, 1500.0))::DOUBLE * 0.065::DOUBLE + greatest(0.0, {x} - 2000.0)::DOUBLE * 0.05::DOUBLE)"


def _rate(x: str) -> str:
    return f"CASE WHEN {x} < 500 THEN 0.08::DOUBLE WHEN {x} < 2000 THEN 0.065::DOUBLE ELSE 0.05::DOUBLE END"


_SERIES = """seeds AS (SELECT DISTINCT strftime(t, '{fmt}') AS bucket FROM (
        SELECT unnest(generate_series(TIMESTAMP '{since}', TIMESTAMP '{until}' - INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS t
        UNION ALL SELECT TIMESTAMP '{until}' - INTERVAL 1 SECOND)),
    used AS (SELECT strftime(created, '{fmt}') AS bucket, sum(billable) AS m, count(*) AS jobs FROM {source}
             WHERE created >= TIMESTAMP '{since}' AND created < TIMESTAMP '{until}' GROUP BY 1),
    run AS (SELECT bucket, coalesce(m, 0) AS m, coalesce(jobs, 0) AS jobs, sum(coalesce(m, 0)) OVER (ORDER BY bucket)::DOUBLE AS total FROM seeds LEFT JOIN used USING (bucket)),
    series AS (SELECT bucket, m::DOUBLE AS minutes, jobs, """ + _price("total") + " - " + _price("coalesce(lag(total) OVER (ORDER BY bucket), 0.0)") + """ AS cost FROM run)"""


def _series(since: str, until: str, fmt: str = "%Y-%m-%d", source: str = "metered") -> str:
    return _SERIES.format(since=since, until=until, fmt=fmt, source=source)


def lineitem_jobs(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("created"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("complete").alias("status"),
        F.col("l_quantity").cast("decimal(18,3)").alias("minutes"),
        F.lit(1).alias("n_langs"),
    )


def quotes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3000).cast("double").alias("used_minutes"), F.col("value").alias("new_minutes"))


def keys(spark, d):
    c = table(spark, d, "customer")
    t = F.lit(NOW).cast("timestamp")
    k = F.col("c_custkey")
    return c.select(
        k.alias("key_id"),
        (t - F.make_dt_interval((k % 400).cast("int"))).alias("created"),
        F.when(k % 3 != 0, t + F.make_dt_interval((k % 40 - 10).cast("int"))).alias("expires"),
        (k % 7 == 0).alias("revoked"),
        F.when(k % 4 != 0, t).alias("last_used"),
    )


KEYS_SQL = f"""keys AS (SELECT c_custkey AS key_id, TIMESTAMP '{NOW}' - to_days((c_custkey % 400)::INTEGER) AS created,
    CASE WHEN c_custkey % 3 != 0 THEN TIMESTAMP '{NOW}' + to_days((c_custkey % 40 - 10)::INTEGER) END AS expires,
    c_custkey % 7 = 0 AS revoked, CASE WHEN c_custkey % 4 != 0 THEN TIMESTAMP '{NOW}' END AS last_used FROM customer),
issues AS (SELECT key_id, CASE WHEN expires < TIMESTAMP '{NOW}' THEN 'expired' WHEN expires < TIMESTAMP '{NOW}' + INTERVAL 7 DAY THEN 'expiring'
    WHEN expires IS NULL AND created < TIMESTAMP '{NOW}' - INTERVAL 180 DAY THEN 'stale' END AS issue FROM keys WHERE NOT revoked)"""


def stage_samples(spark, d):
    j = jobs(spark, d).where(F.col("status").isin("complete", "running"))
    slow = F.when((F.col("stage") == "tts") & (F.col("created") >= F.lit(MIDDLE).cast("timestamp")), 2.0).otherwise(1.0)
    return j.select("stage", (F.col("factor") * slow).alias("rate"), (F.col("created") >= F.lit(MIDDLE).cast("timestamp")).alias("recent"))


SAMPLES_SQL = f"""samples AS (SELECT stage, factor * CASE WHEN stage = 'tts' AND created >= TIMESTAMP '{MIDDLE}' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS rate,
    created >= TIMESTAMP '{MIDDLE}' AS recent FROM jobs WHERE status IN ('complete', 'running')),
health AS (SELECT *, CASE WHEN ratio >= 3.0 THEN 'bad' WHEN ratio >= 1.5 THEN 'warn' ELSE 'ok' END AS severity FROM (
    SELECT *, CASE WHEN runs >= 4 AND baseline_runs >= 8 AND baseline_p95 > 0 THEN p95 / baseline_p95 END AS ratio FROM (
    SELECT stage, count(*) FILTER (recent) AS runs, count(*) FILTER (NOT recent) AS baseline_runs,
           coalesce(quantile_disc(rate, 0.5) FILTER (recent), 0) AS p50, coalesce(quantile_disc(rate, 0.95) FILTER (recent), 0) AS p95,
           coalesce(quantile_disc(rate, 0.95) FILTER (NOT recent), 0) AS baseline_p95 FROM samples GROUP BY stage)))"""

_COUNTS = f"""periods AS (SELECT CASE WHEN created >= TIMESTAMP '{MIDDLE}' AND created < TIMESTAMP '{NOW}' THEN 'current'
        WHEN created >= TIMESTAMP '{EARLY}' AND created < TIMESTAMP '{MIDDLE}' THEN 'previous' END AS period, * FROM metered),
    counts AS (SELECT period, sum(billable)::DOUBLE AS minutes, count(*) AS jobs, count(*) FILTER (state = 'done') AS done,
        count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled, count(*) FILTER (state = 'attention') AS attention,
        count(*) FILTER (state = 'active') AS active FROM periods WHERE period IS NOT NULL GROUP BY period),
    priced AS (SELECT *, {_price("minutes")} AS cost, CASE WHEN done + failed > 0 THEN done / (done + failed) * 100.0::DOUBLE END AS success_pct FROM counts)"""
_WINDOW = f"created >= TIMESTAMP '{EARLY}' AND created < TIMESTAMP '{NOW}'"

QUERIES = {
    "usage_series_daily": lambda s, d: metering.usage_series(jobs(s, d), since=EARLY, until=LATE),
    "usage_series_monthly": lambda s, d: metering.usage_series(jobs(s, d), since=EARLY, until=LATE, bucket="month"),
    "usage_series_lineitem": lambda s, d: metering.usage_series(lineitem_jobs(s, d), since="1993-01-01 00:00:00", until="1997-01-01 00:00:00", bucket="month"),
    "usage_periods": lambda s, d: metering.usage_series(jobs(s, d), since=EARLY, until=LATE, bucket="month").orderBy(F.desc("bucket")).limit(6),
    "usage_summary": lambda s, d: metering.usage_summary(jobs(s, d), since=SINCE, storage_gb=130.0),
    "usage_by_language": lambda s, d: metering.usage_by_language(jobs(s, d), since=SINCE),
    "tier_bands": lambda s, d: metering.tier_bands(metering.usage_by_language(jobs(s, d), since=SINCE)),
    "marginal_cost": lambda s, d: metering.marginal_cost(quotes(s, d)),
    "top_sources": lambda s, d: metering.top_sources(jobs(s, d), since=EARLY, until=NOW),
    "window_counts": lambda s, d: metering.window_counts(jobs(s, d), [("current", MIDDLE, NOW), ("previous", EARLY, MIDDLE)]),
    "unbilled_exposure": lambda s, d: metering.unbilled_exposure(jobs(s, d), since=EARLY, until=NOW),
    "unbilled_examples": lambda s, d: metering.unbilled_examples(jobs(s, d), since=EARLY, until=NOW),
    "revenue_csv": lambda s, d: metering.export_rows(jobs(s, d), since=EARLY, until=NOW),
    "realtime_factor": lambda s, d: metering.realtime_factor(jobs(s, d)),
    "overview_tiles": lambda s, d: console.overview_tiles(jobs(s, d), since=EARLY, middle=MIDDLE, now=NOW),
    "error_mode": lambda s, d: console.most_common_error(jobs(s, d)),
    "stage_health": lambda s, d: console.stage_health(stage_samples(s, d)),
    "stage_alerts": lambda s, d: console.stage_alerts(console.stage_health(stage_samples(s, d))),
    "key_issues": lambda s, d: console.key_issues(keys(s, d), now=NOW),
    "attention": lambda s, d: console.attention(jobs(s, d), keys(s, d), console.stage_alerts(console.stage_health(stage_samples(s, d))), now=NOW),
    "review_queue": lambda s, d: console.usage_anomaly(jobs(s, d), since="2024-01-16 00:00:00", now="2024-01-30 12:00:00"),
    "fleet": lambda s, d: console.fleet(jobs(s, d), now=NOW),
    "pctl_nearest": lambda s, d: console.nearest_rank(jobs(s, d), "status", "factor", {"p50": 0.5, "p95": 0.95}),
    "pctl_linear": lambda s, d: console.linear_percentiles(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p10": 0.1, "p90": 0.9}),
    "median_upper": lambda s, d: console.upper_median(table(s, d, "events").select("user_id", "value"), "user_id", "value"),
}

ORACLES = {
    "usage_series_daily": f"WITH {JOBS_SQL}, {_series(EARLY, LATE)} SELECT * FROM series",
    "usage_series_monthly": f"WITH {JOBS_SQL}, {_series(EARLY, LATE, '%Y-%m')} SELECT * FROM series",
    "usage_series_lineitem": f"WITH metered AS (SELECT l_shipdate AS created, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END::DECIMAL(18,3) AS billable FROM lineitem), {_series('1993-01-01 00:00:00', '1997-01-01 00:00:00', '%Y-%m')} SELECT * FROM series",
    "usage_periods": f"WITH {JOBS_SQL}, {_series(EARLY, LATE, '%Y-%m')} SELECT * FROM series ORDER BY bucket DESC LIMIT 6",
    "usage_summary": f"""WITH {JOBS_SQL}, s AS (SELECT coalesce(sum(billable), 0)::DOUBLE AS minutes, count(*) FILTER (billable > 0) AS jobs_counted,
        count(*) FILTER (billable <= 0 AND status IN ('error', 'cancelled', 'failed')) AS jobs_unbilled,
        coalesce(sum(billable) FILTER (batch_kind = 'showcase'), 0)::DOUBLE AS showcase_minutes FROM metered WHERE created >= TIMESTAMP '{SINCE}')
        SELECT *, {_rate("minutes")} AS rate, CASE WHEN minutes < 500 THEN 500 - minutes WHEN minutes < 2000 THEN 2000 - minutes END AS next_tier_minutes,
               showcase_minutes * 0.02::DOUBLE AS showcase_surcharge, 0.6::DOUBLE AS storage_cost,
               {_price("minutes")} + showcase_minutes * 0.02::DOUBLE + 0.6::DOUBLE AS cost FROM s""",
    "usage_by_language": f"WITH {JOBS_SQL} SELECT target_lang, sum(billable)::DOUBLE AS minutes FROM metered WHERE created >= TIMESTAMP '{SINCE}' AND billable > 0 GROUP BY target_lang",
    "tier_bands": f"""WITH {JOBS_SQL}, u AS (SELECT target_lang, sum(billable)::DOUBLE AS minutes FROM metered WHERE created >= TIMESTAMP '{SINCE}' AND billable > 0 GROUP BY target_lang),
        b(band, from_minutes, to_minutes, rate) AS (VALUES (0, 0.0::DOUBLE, 500.0::DOUBLE, 0.08::DOUBLE), (1, 500.0::DOUBLE, 2000.0::DOUBLE, 0.065::DOUBLE), (2, 2000.0::DOUBLE, NULL, 0.05::DOUBLE))
        SELECT *, used * rate AS cost, minutes > from_minutes AS reached FROM (SELECT *, greatest(0.0, least(minutes - from_minutes, coalesce(to_minutes - from_minutes, 1e300)))::DOUBLE AS used FROM u, b)""",
    "marginal_cost": f"""WITH q AS (SELECT event_id AS id, (event_id % 3000)::DOUBLE AS used_minutes, value AS new_minutes FROM events),
        p AS (SELECT *, {_price("(used_minutes + new_minutes)")} AS total_cost, {_price("(used_minutes + new_minutes)")} - {_price("used_minutes")} AS cost, {_rate("used_minutes")} AS rate FROM q)
        SELECT *, CASE WHEN new_minutes > 0 THEN cost / new_minutes ELSE rate END AS effective_rate FROM p""",
    "top_sources": f"""WITH {JOBS_SQL}, g AS (SELECT batch_id AS batch, sum(billable) AS m, count(*) AS jobs, string_agg(DISTINCT target_lang, ',' ORDER BY target_lang) AS langs,
            min(CASE state WHEN 'failed' THEN 0 WHEN 'attention' THEN 1 WHEN 'cancelled' THEN 1 ELSE 2 END) AS worst, bool_or(batch_kind = 'showcase') AS showcase
            FROM metered WHERE {_WINDOW} GROUP BY batch_id), t AS (SELECT *, m::DOUBLE AS minutes, (SELECT sum(m) FROM g)::DOUBLE AS total FROM g),
        c AS (SELECT *, {_price("total")} * (minutes / total) AS cost FROM t)
        SELECT batch, jobs, langs, minutes, cost, CASE WHEN minutes > 0 THEN cost / minutes ELSE 0 END AS effective_rate,
               CASE WHEN showcase THEN 'showcase' WHEN jobs > 1 THEN 'multi-language' ELSE 'single' END AS mode,
               CASE worst WHEN 0 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'ok' END AS health FROM c ORDER BY minutes DESC, batch LIMIT 10""",
    "window_counts": f"WITH {JOBS_SQL}, {_COUNTS} SELECT * FROM priced",
    "unbilled_exposure": f"""WITH {JOBS_SQL}, u AS (SELECT CASE state WHEN 'active' THEN 'in flight' WHEN 'attention' THEN 'paused for review' ELSE 'failed, never billed' END AS label,
        CASE state WHEN 'failed' THEN 'bad' WHEN 'attention' THEN 'warn' ELSE 'ok' END AS severity, count(*) AS jobs, sum(minutes)::DOUBLE AS minutes
        FROM metered WHERE {_WINDOW} AND state IN ('active', 'attention', 'failed') GROUP BY 1, 2) SELECT *, {_price("minutes")} AS cost FROM u""",
    "unbilled_examples": f"""WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY id) AS nth FROM metered WHERE {_WINDOW} AND state IN ('active', 'attention', 'failed'))
        SELECT state, nth, id, target_lang, status, minutes::DOUBLE AS minutes, left(coalesce(error, ''), 120) AS error FROM r WHERE nth <= 8""",
    "revenue_csv": f"""WITH {JOBS_SQL}, m AS (SELECT *, billable::DOUBLE AS b, (sum(billable) OVER ())::DOUBLE AS total FROM metered WHERE {_WINDOW})
        SELECT id, strftime(created, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created, target_lang, status, b AS minutes, {_price("total")} * (b / total) AS cost FROM m""",
    "realtime_factor": f"WITH {JOBS_SQL} SELECT count(*) AS samples, CASE WHEN count(*) >= 3 THEN median(factor) END AS factor FROM jobs WHERE status = 'complete' AND factor BETWEEN 0.05 AND 200",
    "overview_tiles": f"""WITH {JOBS_SQL}, {_COUNTS}, w AS (SELECT c.minutes AS m, p.minutes AS pm, c.cost AS c, p.cost AS pc, c.jobs::DOUBLE AS j, p.jobs::DOUBLE AS pj, c.success_pct AS s, coalesce(p.success_pct, 0) AS ps
            FROM priced c, priced p WHERE c.period = 'current' AND p.period = 'previous'),
        t AS (SELECT 'revenue' AS tile, c AS value, pc AS before FROM w UNION ALL SELECT 'minutes', m, pm FROM w UNION ALL SELECT 'jobs', j, pj FROM w UNION ALL SELECT 'success', s, ps FROM w)
        SELECT tile, value, CASE WHEN before > 0 THEN (coalesce(value, 0) - before) / before * 100.0::DOUBLE END AS delta_pct FROM t""",
    "error_mode": f"WITH {JOBS_SQL} SELECT left(coalesce(error, 'unknown'), 80) AS reason, count(*) AS jobs, min(id) AS first_id FROM jobs WHERE status = 'error' GROUP BY 1 ORDER BY jobs DESC, first_id LIMIT 1",
    "stage_health": f"WITH {JOBS_SQL}, {SAMPLES_SQL} SELECT * FROM health",
    "stage_alerts": f"WITH {JOBS_SQL}, {SAMPLES_SQL} SELECT * FROM health WHERE severity IN ('warn', 'bad')",
    "key_issues": f"WITH {KEYS_SQL} SELECT key_id, issue, CASE issue WHEN 'expired' THEN 'bad' ELSE 'warn' END AS severity FROM issues WHERE issue IS NOT NULL",
    "attention": f"""WITH {JOBS_SQL}, {SAMPLES_SQL}, {KEYS_SQL}, k AS (SELECT CASE WHEN state = 'failed' AND created >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'failed' WHEN state = 'attention' THEN 'paused'
            WHEN state = 'active' AND created < TIMESTAMP '{NOW}' - INTERVAL 1 DAY THEN 'stale' END AS kind, id FROM metered)
        SELECT kind, count(*) AS n, min(id)::VARCHAR AS target, CASE kind WHEN 'failed' THEN 'bad' ELSE 'warn' END AS severity FROM k WHERE kind IS NOT NULL GROUP BY kind
        UNION ALL SELECT 'slow stage', runs, stage, severity FROM health WHERE severity IN ('warn', 'bad')
        UNION ALL SELECT 'key ' || issue, 1, key_id::VARCHAR, CASE issue WHEN 'expired' THEN 'bad' ELSE 'warn' END FROM issues WHERE issue IS NOT NULL""",
    "review_queue": f"""WITH {JOBS_SQL}, {_series("2024-01-16 00:00:00", "2024-01-30 12:00:00")}, l AS (SELECT max(bucket) AS last_bucket FROM series),
        m AS (SELECT list(minutes ORDER BY minutes) AS m FROM series, l WHERE bucket < last_bucket)
        SELECT bucket, minutes, m[len(m) // 2 + 1] AS median, (len(m) + 1)::INTEGER AS buckets,
               len(m) + 1 >= 8 AND minutes >= 30 AND m[len(m) // 2 + 1] > 0 AND minutes / m[len(m) // 2 + 1] >= 3.0 AS anomaly FROM series, l, m WHERE bucket = last_bucket""",
    "fleet": f"""WITH {JOBS_SQL}, r AS (SELECT *, created >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS recent FROM metered),
        s AS (SELECT count(*) FILTER (state = 'active') AS running, count(*) FILTER (recent AND state = 'done') AS done, count(*) FILTER (recent AND state = 'failed') AS failed FROM r),
        t AS (SELECT left(coalesce(error, 'unknown'), 60) AS top_cause FROM r WHERE recent AND state = 'failed' GROUP BY 1 ORDER BY count(*) DESC, min(id) LIMIT 1)
        SELECT *, CASE WHEN fail_pct > 10 THEN 'warn' ELSE 'ok' END AS status FROM (
            SELECT running, done, failed, top_cause, CASE WHEN done + failed > 0 THEN failed / (done + failed) * 100.0::DOUBLE END AS fail_pct FROM s LEFT JOIN t ON true)""",
    "pctl_nearest": f"WITH {JOBS_SQL} SELECT status, quantile_disc(factor, 0.5) AS p50, quantile_disc(factor, 0.95) AS p95, count(factor) AS samples FROM jobs GROUP BY status",
    "pctl_linear": "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    "median_upper": "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS upper_median FROM r WHERE nth = n // 2",
}
