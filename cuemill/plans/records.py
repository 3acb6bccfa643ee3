"""Queries of job-record and workbench operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.operators import folds, metering, speakers, timeline, workbench
from cuemill.plans.usage import KEYS_SQL, keys
from cuemill.sources import sinks
from cuemill.sources.standin import JOBS_SQL, NOW, SEGMENTS_SQL, jobs, segments, table

#: Which publish states an action may start from ("" before the first).
PUBLISH = [
    ("stage", ["", "staged", "approved", "uploaded", "failed", "cancelled"]),
    ("approve", ["staged", "failed"]),
    ("cancel", ["staged", "approved", "failed"]),
    ("upload", ["approved"]),
]
_ACTIONS = ["stage", "approve", "cancel", "upload", "publish"]
_PUBLISHED = ["", "staged", "approved", "uploading", "uploaded", "failed", "cancelled"]
SIGNING_KEY = b"test-key"


def _pick(values, index):
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def publish(s, d):
    """Whether an action is legal from a state: a join with the transitions (a few rows)."""
    allowed = s.createDataFrame([(a, x) for a, xs in PUBLISH for x in xs], "action string, state string").withColumn("legal", F.lit(True))
    k = F.col("event_id")
    rows = table(s, d, "events").select("event_id", _pick(_ACTIONS, k % 5).alias("action"), _pick(_PUBLISHED, k % 7).alias("state"))
    return rows.join(F.broadcast(allowed), ["action", "state"], "left").select("event_id", "action", "state", F.coalesce("legal", F.lit(False)).alias("legal"))


def attempts(s, d):
    rows = workbench.attempts(jobs(s, d).select("id", "batch_id", "stage", "created"), ["batch_id", "stage"], ["created", "id"])
    return rows.select("id", "batch_id", "stage", "attempt", "latest")


def upstream(s, d):
    return workbench.upstream(segments(s, d), "job", "idx", F.col("tier") % 2 == 0).select("job", "idx", "upstream")


def gates(s, d):
    x = segments(s, d)
    states = x.groupBy("job").agg(F.max("idx").alias("nth"))
    rows = x.select("job", F.concat(F.lit("gate "), F.col("idx")).alias("gate"), F.col("idx").alias("at"), (F.col("tier") > 0).alias("armed"), F.col("measured").alias("cleared"), F.when(F.col("idx") % 3 != 0, F.col("tier") - 1).alias("findings"))
    return workbench.first_gate(states, rows)


def notices(s, d):
    k = F.col("id")
    rows = jobs(s, d).select("batch_id", (k % 3).alias("code"), _pick(["ok", "warn", "bad"], F.floor(k / 3) % 3).alias("severity"), k.alias("pos"))
    return workbench.merge_notices(rows, "batch_id")


def overridden(s, d):
    x = segments(s, d)
    changes = x.where("idx % 3 = 1").select("job", "idx", (F.col("tier") * 300 - 600).alias("delta_start"), F.when(F.col("measured"), F.lit(900)).alias("delta_end"))
    return workbench.override_cues(x, changes)


def slides(s, d):
    x = segments(s, d).select("job", "idx", "start_ms", "end_ms", F.when(F.col("idx") % 3 != 1, F.concat(F.lit("p"), F.floor(F.col("idx") / 4))).alias("image"))
    return workbench.slide_spans(x)


def accounts(s, d):
    """Keys by state: how many, and the newest."""
    now = F.lit(NOW).cast("timestamp")
    k = keys(s, d).withColumn("state", scalars.key_state(F.col("revoked"), F.col("expires"), F.col("last_used"), now))
    return k.groupBy("state").agg(F.count(F.lit(1)).alias("keys"), F.max("key_id").alias("newest"))


def breaker(s, d):
    rows = jobs(s, d).select("batch_id", "id", F.col("status").isin("error", "running").alias("failed"))
    return workbench.breaker(rows, "batch_id", "id")


def suffixed(s, d):
    rows = table(s, d, "documents").select("doc_id", scalars.slug(F.col("text")).alias("base"))
    return workbench.suffixed(rows, "base", ["doc_id"]).select("doc_id", "unique_id")


def log_windows(s, d):
    log = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"))
    failures = table(s, d, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("at"))
    return workbench.around(log, "user_id", failures, before=3, after=2)


def glossary(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("term"), F.col("c_custkey").alias("k"))
    old = c.where("k % 2 = 0").select("term", F.lit("old").alias("dst"), F.when(F.col("k") % 4 == 0, "a").alias("say"))
    new = c.where("k % 3 = 0").select("term", F.when(F.col("k") % 9 == 0, "new").alias("dst"), F.lit("b").alias("say"))
    return workbench.merge_terms(old, new)


def speaker_edits(s, d):
    edits = s.createDataFrame([("user", "guest"), ("system", None)], "speaker string, becomes string")
    return workbench.edit_speakers(segments(s, d), edits)


def webhooks(s, d):
    hooks = s.createDataFrame([(1, True, ["error", "purchase"]), (2, False, ["error"]), (3, True, ["view"])], "hook_id int, enabled boolean, events array<string>")
    rows = workbench.deliveries(table(s, d, "events").select("event_id", "event_type"), hooks)
    body = F.concat(F.col("event_type"), F.lit(":"), F.col("event_id"))
    return rows.select("hook_id", "event_id", workbench.hmac_sha256(body, SIGNING_KEY).alias("signature"))


def digests(s, d):
    """A digest of each job's lines in order."""
    rows = segments(s, d).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"))
    return rows.select("job", F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["idx"].cast("string"), F.lit(":"), r["text"])), "|"), 256).alias("digest"))


def loudness(s, d):
    k = F.col("event_id")
    value = F.when(k % 5 == 0, F.lit("-inf")).otherwise((-(k % 40) / F.lit(2.0)).cast("string"))
    log = F.concat(F.lit('frame=1 {"x": "1"} {"input_i": "0", "input_tp": "0", "input_lra": "0"}\n{"input_i": "'), value, F.lit('", "input_tp": "-1.5", "input_lra": "7"} done'))
    return table(s, d, "events").select("event_id", workbench.loudness(log).alias("l")).select("event_id", "l.*")


def month(s, d):
    return workbench.month_to_date(jobs(s, d), now=NOW)


def speaker_cards(s, d):
    x = segments(s, d)
    who = x.select("job", "speaker").distinct()
    k = F.col("job")
    labels = who.where(k % 2 == 0).select("job", "speaker", F.when(k % 4 == 0, F.concat("speaker", F.lit(" L"))).otherwise("").alias("label"))
    matches = who.where(k % 3 == 0).select("job", "speaker", F.lit("profile").alias("match"))
    confirmed = who.where((k % 5 == 0) & (F.col("speaker") == "user")).select("job", "speaker", F.concat(F.lit("Guest "), k.cast("string")).alias("confirmed"))
    return speakers.cards(x, labels, matches, confirmed)


def uncast(s, d):
    x = segments(s, d)
    return speakers.cast_findings(x, x.where((F.col("job") % 3 == 0) & (F.col("speaker") == "user")).select("job", "speaker"))


def fits(s, d):
    x = segments(s, d).withColumn("translated", F.when(F.col("idx") % 4 == 0, F.concat(F.lit("  (happy) "), "translated")).when(F.col("idx") % 4 == 1, F.concat(F.lit("( "), F.repeat(F.lit("x"), 40), F.lit(")"))).otherwise(F.col("translated")))
    own = x.where("idx % 3 = 1").select("job", "idx", (F.col("tier") * 0.9 + 0.5).alias("max_stretch"), (F.col("tier") * 100 - 100).alias("pad_ms"))
    return timeline.fit_limits(x, own, base=1.4)


def glossaries(s, d):
    """Customers as terms of domains by nation: of each name's first digits, in one of three languages or in none."""
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("pos"), F.when(k % 4 == 0, "DE-de").when(k % 4 == 1, " fr ").when(k % 4 == 2, "").alias("target_lang"), F.concat(F.when(k % 6 == 0, " ").otherwise(""), F.lit("term "), (k % 50).cast("string")).alias("term"), F.when(k % 3 != 0, F.concat(F.lit("dst "), k.cast("string"))).otherwise(" ").alias("dst"), F.when(k % 5 == 0, F.concat(F.lit(" say "), k.cast("string"))).alias("say"))
    return workbench.glossary_for(rows, "de")


def numbered(s, d):
    """Each job's segments as a numbered reply in one of three forms; every fifth job's lacks its second number."""
    idx, text = F.col("idx"), F.col("text")
    n = (idx + 1).cast("string")
    form = F.when(F.col("job") % 3 == 0, F.concat(n, F.lit(". "), text)).when(F.col("job") % 3 == 1, F.concat(F.lit("["), n, F.lit("] "), text)).otherwise(F.concat(F.lit("**"), n, F.lit(":** "), text))
    line = F.when((F.col("job") % 5 == 0) & (idx == 1), text).otherwise(form)
    rows = segments(s, d).groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("reply"), F.count(F.lit(1)).cast("int").alias("n"))
    found = folds.numbered_reply(F.concat(F.lit("Sure:\n"), F.col("reply")), F.col("n"))
    return rows.select("job", "n", F.md5(F.array_join(found, "|")).alias("lines"))


def speaker_ops(s, d):
    """Four edits of each job, one of them only where the job's number is even, in their order."""
    of = lambda nth, op, speaker=None, becomes=None, idx=None, label=None: F.struct(F.lit(nth).alias("nth"), F.lit(op).alias("op"), F.lit(speaker).cast("string").alias("speaker"), F.lit(becomes).cast("string").alias("becomes"), F.lit(idx).cast("long").alias("idx"), F.lit(label).cast("string").alias("label"))
    ops = [of(4, "merge", "guest", "host"), of(1, "merge", "user", "guest"), of(2, "reassign", None, "user", 2), of(3, "mark_non_speech", idx=1), of(5, "rename", "user", label="U")]
    edits = segments(s, d).select("job").distinct().select("job", F.inline(F.array(*ops))).where("job % 2 = 0 OR nth != 4")
    return speakers.edited(segments(s, d), edits)


def sibling_targets(s, d):
    """A request for each tenth job of the jobs of one day, about all jobs of its batch."""
    rows = jobs(s, d).where("created < timestamp '2024-01-02'").select(F.col("id").alias("job"), "batch_id", F.when(F.col("status") == "running", "synthesizing").otherwise(F.col("status")).alias("status"), (F.col("id") % 3 != 0).alias("transcribed"))
    requests = rows.where("job % 10 = 0").select(F.col("job").alias("request"), "job", (F.col("job") % 20 == 0).alias("apply_to_siblings"))
    return speakers.targets(requests, rows)


QUERIES = {
    "speaker_ops": speaker_ops,
    "speaker_cards": speaker_cards,
    "cast_findings": uncast,
    "fit_limits": fits,
    "glossary_flat": glossaries,
    "numbered_lines": numbered,
    "sibling_targets": sibling_targets,
    "publish_transitions": publish,
    "attempts": attempts,
    "upstream_checkpoint": upstream,
    "review_gates": gates,
    "notice_merge": notices,
    "cue_overrides": overridden,
    "slide_spans": slides,
    "accounts": accounts,
    "breaker_replay": breaker,
    "duplicate_suffix": suffixed,
    "log_window": log_windows,
    "glossary_merge": glossary,
    "speaker_edits": speaker_edits,
    "webhook_deliveries": webhooks,
    "segment_hash": digests,
    "loudness_log": loudness,
    "month_to_date": month,
    "job_cost": lambda s, d: workbench.job_costs(jobs(s, d)),
    "error_history": lambda s, d: workbench.newest(jobs(s, d).where("error IS NOT NULL"), "batch_id", ["created", "id"], 8).select("batch_id", "nth", "id", "error"),
    "speaker_rows": lambda s, d: workbench.speaker_rows(segments(s, d)),
    "sync_plan": lambda s, d: workbench.sync_plan(segments(s, d)),
    "storage_cleanup": lambda s, d: workbench.cleanup(jobs(s, d), now=NOW, days=7, errored=True).select("id", "status"),
    "resource_summary": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("samples"), (F.sum(F.col("value").cast("decimal(18,3)")).cast("double") / F.count("value")).alias("mean")),
    "synthesis_stats": lambda s, d: segments(s, d).groupBy("job").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cer") <= 0.4).alias("ok"), F.count_if(F.col("tier") == 0).alias("degraded"), F.count_if(~F.col("measured")).alias("unmeasured")),
    "low_asr": lambda s, d: segments(s, d).where(scalars.low_confidence(F.size(F.split(F.trim("text"), r"\s+")), F.col("cer"), F.col("no_speech"), F.col("logprob"))).select("job", "idx"),
    "cue_split": lambda s, d: workbench.split_cues(segments(s, d)),
    "vtt": lambda s, d: sinks.vtt_text(segments(s, d)).select("job", F.md5("vtt").alias("digest")),
    "transcript": lambda s, d: sinks.transcript_text(segments(s, d)).select("job", F.md5("transcript").alias("digest")),
    "concat_list": lambda s, d: sinks.concat_list(segments(s, d).withColumn("image", F.concat(F.lit("it's "), F.col("idx"), F.lit(".png")))),
    "estimate_quote": lambda s, d: metering.marginal_cost(jobs(s, d).where("minutes IS NOT NULL").select("id", (F.col("id") % 2500).cast("double").alias("used_minutes"), (F.col("minutes").cast("double") * F.col("n_langs")).alias("new_minutes"))),
}

_ALLOWED = ", ".join(f"('{a}', '{x}')" for a, xs in PUBLISH for x in xs)


def _price(x: str) -> str:
    return f"(least({x}, 500.0::DOUBLE) * 0.08::DOUBLE + greatest(0.0::DOUBLE, least({x} - 500, 1500.0::DOUBLE)) * 0.065::DOUBLE + greatest(0.0::DOUBLE, {x} - 2000) * 0.05::DOUBLE)"


def _rate(x: str) -> str:
    return f"CASE WHEN {x} < 500 THEN 0.08::DOUBLE WHEN {x} < 2000 THEN 0.065::DOUBLE ELSE 0.05::DOUBLE END"


def _clock(x: str, dot: str) -> str:
    two = lambda v: f"lpad(({v})::BIGINT::VARCHAR, 2, '0')"
    return f"{two(f'{x} // 3600000')} || ':' || {two(f'{x} // 60000 % 60')} || ':' || {two(f'{x} // 1000 % 60')}" + (f" || '{dot}' || lpad(({x} % 1000)::VARCHAR, 3, '0')" if dot else "")


ORACLES = {
    "speaker_cards": f"""WITH {SEGMENTS_SQL}, t AS (SELECT job, speaker, sum(greatest(end_ms - start_ms, 0))::BIGINT AS talk_ms, count(*) AS lines FROM segments GROUP BY ALL),
        j AS (SELECT *, CASE WHEN job % 4 = 0 THEN speaker || ' L' END AS label, CASE WHEN job % 3 = 0 THEN 'profile' END AS match, CASE WHEN job % 5 = 0 AND speaker = 'user' THEN 'Guest ' || job END AS confirmed FROM t)
        SELECT job, row_number() OVER (PARTITION BY job ORDER BY talk_ms DESC, speaker)::INTEGER AS nth, speaker, coalesce(confirmed, label, speaker) AS display, label, match, confirmed, talk_ms, lines FROM j""",
    "cast_findings": f"""WITH {SEGMENTS_SQL}, w AS (SELECT DISTINCT job, speaker FROM segments WHERE speaker != '')
        SELECT job, CASE WHEN count(*) > 1 THEN count(*) FILTER (NOT (job % 3 = 0 AND speaker = 'user')) ELSE 0 END AS findings FROM w GROUP BY job""",
    "fit_limits": f"""WITH {SEGMENTS_SQL} SELECT job, idx, CASE WHEN idx % 3 = 1 THEN least(greatest(tier * 0.9::DOUBLE + 0.5::DOUBLE, 1.0::DOUBLE), 2.5::DOUBLE) ELSE 1.4::DOUBLE END + CASE WHEN idx % 4 = 0 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END AS max_stretch,
        CASE WHEN idx % 3 = 1 THEN greatest(tier * 100 - 100, 0) ELSE 0 END AS pad_ms FROM segments""",
    "glossary_flat": """WITH r AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE '' END || 'term ' || (c_custkey % 50) AS term, CASE WHEN c_custkey % 3 != 0 THEN 'dst ' || c_custkey END AS dst, CASE WHEN c_custkey % 5 = 0 THEN 'say ' || c_custkey END AS say FROM customer WHERE c_custkey % 4 != 1),
        a AS (SELECT term, arg_max(dst, pos) AS dst FROM r WHERE dst IS NOT NULL GROUP BY term), b AS (SELECT trim(term) AS term, arg_max(say, pos) AS say FROM r WHERE say IS NOT NULL GROUP BY trim(term))
        SELECT term, dst, say FROM a FULL JOIN b USING (term)""",
    "numbered_lines": f"""WITH {SEGMENTS_SQL} SELECT job, count(*)::INTEGER AS n, CASE WHEN job % 5 != 0 OR count(*) < 2 THEN md5(string_agg(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != ''), ' '), '|' ORDER BY idx)) END AS lines FROM segments GROUP BY job""",
    "duplicate_suffix": """WITH b AS (SELECT doc_id, left(lower(regexp_replace(regexp_replace(text, '[^\\pL\\pN]+', '-', 'g'), '^-+|-+$', '', 'g')), 48) AS base FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM b) SELECT doc_id, base || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS unique_id FROM n""",
    "webhook_deliveries": f"""WITH hooks(hook_id, enabled, kinds) AS (VALUES (1, true, ['error', 'purchase']), (2, false, ['error']), (3, true, ['view'])),
        w AS (SELECT hook_id, event_id, event_type || ':' || event_id AS body FROM events JOIN hooks ON enabled AND list_contains(kinds, event_type))
        SELECT hook_id, event_id, sha256(unhex('{bytes(x ^ 0x5C for x in SIGNING_KEY.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(x ^ 0x36 for x in SIGNING_KEY.ljust(64, bytes(1))).hex()}') || encode(body)))) AS signature FROM w""",
    "speaker_ops": f"""WITH {SEGMENTS_SQL} SELECT job, idx, CASE WHEN idx = 2 THEN 'user' WHEN speaker IN ('user', 'guest') THEN CASE WHEN job % 2 = 0 THEN 'host' ELSE 'guest' END ELSE speaker END AS speaker, idx = 1 AS non_speech,
        (CASE WHEN idx = 2 THEN 0 WHEN speaker = 'user' THEN 1 + (job % 2 = 0)::INTEGER WHEN speaker = 'guest' THEN (job % 2 = 0)::INTEGER ELSE 0 END)::INTEGER AS merged FROM segments""",
    "sibling_targets": f"""WITH {JOBS_SQL}, r AS (SELECT id AS job, batch_id, CASE WHEN status = 'running' THEN 'synthesizing' ELSE status END AS status, id % 3 != 0 AS transcribed FROM jobs WHERE created < TIMESTAMP '2024-01-02'),
        t AS (SELECT q.job AS request, o.job, o.status, o.transcribed FROM r q JOIN r o ON q.job % 10 = 0 AND (q.job = o.job OR q.job % 20 = 0 AND q.batch_id = o.batch_id)),
        w AS (SELECT request, job, CASE WHEN status NOT IN ('review', 'paused', 'error') THEN 'busy' WHEN NOT transcribed THEN 'no checkpoint' END AS reason FROM t)
        SELECT request, job, reason IS NULL AS ok, reason FROM w""",
    "publish_transitions": f"""WITH a(action, state) AS (VALUES {_ALLOWED}), e AS (SELECT event_id, {_ACTIONS}[event_id % 5 + 1] AS action, {_PUBLISHED}[event_id % 7 + 1] AS state FROM events)
        SELECT *, (action, state) IN (SELECT (action, state) FROM a) AS legal FROM e""",
    "attempts": f"""WITH {JOBS_SQL} SELECT id, batch_id, stage, row_number() OVER w AS attempt, row_number() OVER w = count(*) OVER (PARTITION BY batch_id, stage) AS latest
        FROM jobs WINDOW w AS (PARTITION BY batch_id, stage ORDER BY created, id)""",
    "upstream_checkpoint": f"WITH {SEGMENTS_SQL} SELECT job, idx, max(CASE WHEN tier % 2 = 0 THEN idx END) OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upstream FROM segments",
    "review_gates": f"""WITH {SEGMENTS_SQL} SELECT job, max(idx) AS nth, 'gate ' || min(idx) FILTER (tier > 0 AND NOT measured AND (idx % 3 = 0 OR tier > 1)) AS gate FROM segments GROUP BY job""",
    "notice_merge": f"""WITH {JOBS_SQL}, n AS (SELECT batch_id, id % 3 AS code, id // 3 % 3 AS level, id FROM jobs),
        r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, code ORDER BY level DESC, id DESC) AS nth, count(*) OVER (PARTITION BY batch_id, code) AS times FROM n)
        SELECT batch_id, code, ['ok', 'warn', 'bad'][level + 1] AS severity, id AS pos, times FROM r WHERE nth = 1""",
    "cue_overrides": f"""WITH {SEGMENTS_SQL} SELECT job, idx, start_ms + CASE WHEN idx % 3 = 1 THEN greatest(-500, least(500, tier * 300 - 600)) ELSE 0 END AS start_ms,
        end_ms + CASE WHEN idx % 3 = 1 AND measured THEN 500 ELSE 0 END AS end_ms FROM segments""",
    "slide_spans": f"""WITH {SEGMENTS_SQL}, x AS (SELECT job, idx, start_ms, end_ms, CASE WHEN idx % 3 != 1 THEN 'p' || (idx // 4) END AS image FROM segments),
        y AS (SELECT *, last_value(image IGNORE NULLS) OVER (PARTITION BY job ORDER BY idx ROWS UNBOUNDED PRECEDING) AS shown FROM x),
        z AS (SELECT *, sum(CASE WHEN shown IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT *, lag(shown) OVER (PARTITION BY job ORDER BY idx) AS before FROM y WHERE shown IS NOT NULL))
        SELECT job, min(shown) AS image, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM z GROUP BY job, run""",
    "accounts": f"""WITH {KEYS_SQL} SELECT CASE WHEN revoked THEN 'revoked' WHEN expires < TIMESTAMP '{NOW}' THEN 'expired' WHEN expires < TIMESTAMP '{NOW}' + INTERVAL 7 DAY THEN 'expiring'
        WHEN last_used IS NULL THEN 'idle' ELSE 'active' END AS state, count(*) AS keys, max(key_id) AS newest FROM keys GROUP BY 1""",
    "breaker_replay": f"""WITH {JOBS_SQL}, o AS (SELECT batch_id, id, status IN ('error', 'running') AS failed FROM jobs),
        i AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY batch_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS island FROM o),
        r AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY batch_id, island ORDER BY id ROWS UNBOUNDED PRECEDING) AS in_a_row FROM i)
        SELECT batch_id, id, failed, in_a_row, in_a_row >= 3 AS open FROM r""",
    "log_window": """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
        SELECT l.user_id, l.event_id AS seq, f.event_id AS "at" FROM r l JOIN r f ON l.user_id = f.user_id AND f.event_type = 'error' AND l.n BETWEEN f.n - 2 AND f.n + 2""",
    "glossary_merge": """SELECT c_custkey::VARCHAR AS term, CASE WHEN c_custkey % 9 = 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'old' END AS dst,
        CASE WHEN c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 4 = 0 THEN 'a' END AS say FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
    "speaker_edits": f"WITH {SEGMENTS_SQL} SELECT job, idx, CASE speaker WHEN 'user' THEN 'guest' WHEN 'system' THEN NULL ELSE speaker END AS speaker, speaker = 'system' AS non_speech FROM segments",
    "segment_hash": f"WITH {SEGMENTS_SQL} SELECT job, sha256(string_agg(idx || ':' || text, '|' ORDER BY idx)) AS digest FROM segments GROUP BY job",
    "loudness_log": """SELECT event_id, CASE WHEN event_id % 5 != 0 THEN -(event_id % 40) / 2.0::DOUBLE END AS i, -1.5::DOUBLE AS tp, 7.0::DOUBLE AS lra FROM events""",
    "month_to_date": f"""WITH {JOBS_SQL}, t AS (SELECT coalesce(sum(billable), 0)::DOUBLE AS minutes, count(*) FILTER (billable > 0) AS jobs FROM metered
        WHERE created >= date_trunc('month', TIMESTAMP '{NOW}') AND created <= TIMESTAMP '{NOW}') SELECT *, {_price("minutes")} AS cost, {_rate("minutes")} AS rate FROM t""",
    "job_cost": f"""WITH {JOBS_SQL}, r AS (SELECT id, billable::DOUBLE AS minutes, coalesce(sum(billable) OVER (ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b FROM metered)
        SELECT id, minutes, {_price("(b + minutes)")} - {_price("b")} AS cost FROM r""",
    "error_history": f"""WITH {JOBS_SQL}, r AS (SELECT batch_id, id, error, row_number() OVER (PARTITION BY batch_id ORDER BY created DESC, id DESC) AS nth FROM jobs WHERE error IS NOT NULL) SELECT batch_id, nth, id, error FROM r WHERE nth <= 8""",
    "speaker_rows": f"""WITH {SEGMENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job, speaker ORDER BY length(text), idx) - 1 AS spot, count(*) OVER (PARTITION BY job, speaker) AS lines, count(*) OVER (PARTITION BY job) AS n FROM segments)
        SELECT job, speaker, max(lines) AS lines, max(idx) FILTER (spot = lines // 2) AS sample_idx, max(lines) / max(n) AS share FROM r GROUP BY job, speaker""",
    "sync_plan": f"WITH {SEGMENTS_SQL} SELECT job, idx, dub_ms / (end_ms - start_ms) AS max_stretch FROM segments WHERE end_ms > start_ms AND dub_ms / (end_ms - start_ms) > 1.05::DOUBLE AND dub_ms / (end_ms - start_ms) <= 1.4::DOUBLE",
    "storage_cleanup": f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE status IN ('complete', 'error') AND created < TIMESTAMP '{NOW}' - INTERVAL 7 DAY",
    "resource_summary": "SELECT event_type, max(value) AS peak, count(*) AS samples, sum(CAST(value AS DECIMAL(18,3)))::DOUBLE / count(value) AS mean FROM events GROUP BY event_type",
    "synthesis_stats": f"WITH {SEGMENTS_SQL} SELECT job, count(*) AS total, count(*) FILTER (cer <= 0.4) AS ok, count(*) FILTER (tier = 0) AS degraded, count(*) FILTER (NOT measured) AS unmeasured FROM segments GROUP BY job",
    "low_asr": f"WITH {SEGMENTS_SQL} SELECT job, idx FROM segments WHERE len(regexp_split_to_array(trim(text), '\\s+')) >= 3 AND ((cer < 0.5::DOUBLE AND no_speech < 0.15::DOUBLE) OR logprob < -0.9::DOUBLE)",
    "cue_split": f"""WITH {SEGMENTS_SQL}, p AS (SELECT job, idx, start_ms, end_ms, length(text) AS n, greatest((length(text) + 41) // 42, 1) AS parts FROM segments),
        q AS (SELECT *, unnest(range(0, parts)) AS part FROM p)
        SELECT job, idx, part::INTEGER AS part, start_ms + (end_ms - start_ms) * (n * part // parts) // greatest(n, 1) AS start_ms,
               CASE WHEN n = 0 THEN end_ms ELSE start_ms + (end_ms - start_ms) * (n * (part + 1) // parts) // greatest(n, 1) END AS end_ms FROM q""",
    "vtt": f"""WITH {SEGMENTS_SQL} SELECT job, md5('WEBVTT' || chr(10) || chr(10) || string_agg({_clock("start_ms", ".")} || ' --> ' || {_clock("end_ms", ".")} || chr(10) || text || chr(10), chr(10) ORDER BY idx)) AS digest FROM segments GROUP BY job""",
    "transcript": f"""WITH {SEGMENTS_SQL} SELECT job, md5(string_agg('[' || {_clock("start_ms", "")} || '] ' || coalesce(speaker, '') || ': ' || trim(text), chr(10) ORDER BY idx)) AS digest FROM segments GROUP BY job""",
    "concat_list": f"""WITH {SEGMENTS_SQL}, x AS (SELECT job, idx, 'file ''it''\\''''s ' || idx || '.png''' AS line, printf('%.3f', (end_ms - start_ms) / 1000.0::DOUBLE) AS secs FROM segments)
        SELECT job, 'ffconcat version 1.0' || chr(10) || string_agg(line || chr(10) || 'duration ' || secs, chr(10) ORDER BY idx) || chr(10) || arg_max(line, idx) || chr(10) AS list FROM x GROUP BY job""",
    "estimate_quote": f"""WITH {JOBS_SQL}, q AS (SELECT id, (id % 2500)::DOUBLE AS u, minutes::DOUBLE * n_langs AS n FROM jobs WHERE minutes IS NOT NULL)
        SELECT id, u AS used_minutes, n AS new_minutes, {_price("(u + n)")} - {_price("u")} AS cost, {_rate("u")} AS rate, {_price("(u + n)")} AS total_cost,
               CASE WHEN n > 0 THEN ({_price("(u + n)")} - {_price("u")}) / n ELSE {_rate("u")} END AS effective_rate FROM q""",
}
