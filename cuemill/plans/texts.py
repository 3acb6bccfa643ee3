"""Queries of text, audit, vector and stream operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx
from cuemill.operators import corpus_audit, flags, folds, prints, titles
from cuemill.sources.scratch import folder
from cuemill.sources.standin import JOBS_SQL, NOW, SEGMENTS_SQL, jobs, segments, table
from cuemill.streaming import activity, log

STOPWORDS = ["the", "and", "for", "der", "die", "les", "los", "las"]


def docs(s, d):
    return table(s, d, "documents")


def messages(s, d):
    """Error messages made of an event's numbers."""
    return _messages_of(table(s, d, "events"))


def _messages_of(e):
    k = F.col("event_id").cast("string")
    return e.select("event_id", F.col("event_type").alias("stage"), F.concat(F.lit("Cannot read /data/jobs/"), k, F.lit("/out.wav at 0x"), F.hex("event_id"), F.lit(" after "), k, F.lit(".5 s, token=abc"), k, F.lit(" hf_abcdefgh"), k).alias("message"))


_MESSAGES = """messages AS (SELECT event_id, event_type AS stage, 'Cannot read /data/jobs/' || event_id || '/out.wav at 0x' || upper(hex(event_id)) || ' after ' || event_id || '.5 s, token=abc' || event_id || ' hf_abcdefgh' || event_id AS message FROM events)"""


def durations(s, d):
    e = table(s, d, "events")
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("s"))).when(k % 4 == 1, F.concat((k % 60).cast("string"), F.lit(":07"))).when(k % 4 == 2, F.concat((k % 9).cast("string"), F.lit(":12:"), (k % 50 + 10).cast("string"))).otherwise(F.lit("N/A"))
    return e.select("event_id", text.alias("text"))


def duplicate_scores(s, d):
    """Every part's name as a new title against the names of the 25 nations, a table of fixed size, as known titles.

    Different titles are compared, and parts of one title and duration have one score.
    """
    parts = table(s, d, "part").select("p_partkey", scalars.normalise_title(F.col("p_name")).alias("title"), (F.col("p_partkey") % 40).alias("seconds"))
    known = table(s, d, "nation").select((F.col("n_nationkey") % 40).alias("other"), scalars.normalise_title(F.col("n_name")).alias("other_title")).where("other IS NOT NULL")
    ratios = parts.select("title").distinct().crossJoin(F.broadcast(known.select("other_title").distinct())).select("title", "other_title", tx.sequence_ratio("title", "other_title").alias("ratio"))
    asked = parts.select(F.col("title").alias("t"), F.col("seconds").alias("s")).distinct()
    scored = asked.join(ratios.hint("merge"), F.col("t").eqNullSafe(F.col("title"))).join(F.broadcast(known.withColumnRenamed("other_title", "o")), F.col("o").eqNullSafe(F.col("other_title")))
    best = scored.groupBy("t", "s").agg(F.max(tx.duplicate_score(F.col("ratio"), F.col("s"), F.col("other"))).alias("best"))
    found = parts.join(best, F.col("title").eqNullSafe(F.col("t")) & F.col("seconds").eqNullSafe(F.col("s")), "left")
    return found.groupBy("p_partkey").agg(F.max("best").alias("best")).withColumn("verdict", tx.duplicate_verdict(F.col("best")))


def duplicate_titles(s, d):
    """Every part's name against all other parts' names."""
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 40).cast("double").alias("seconds"))
    return titles.duplicate_titles(parts).withColumnRenamed("id", "p_partkey")


def print_inputs(s, d):
    """What decides the stages of each conversation as a job."""
    x = segments(s, d)
    seconds = x.select("job", "idx", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", "translated", "speaker")
    k = F.col("job")
    rows = x.groupBy("job").agg(F.min_by("text", "idx").alias("initial_prompt"))
    rows = rows.select("job", "initial_prompt", F.sha2(k.cast("string"), 256).alias("source_fingerprint"), (k % 2 == 0).alias("auto_denoise"), F.lit(True).alias("vad_enabled"), ((k % 8) / F.lit(16.0)).alias("vad_threshold"), F.lit('m"1').alias("whisper_model"), F.lit("none").alias("reference_audio_fingerprint"), F.when(k % 3 == 0, k).alias("min_speakers"), F.when(k % 7 != 0, "g").otherwise("").alias("glossary_fingerprint"), F.lit("r").alias("speaker_refs_fingerprint"), F.lit("de").alias("target_lang"))
    return rows.join(prints.segment_prints(seconds), "job")


def coverage(s, d):
    before = segments(s, d).select("job", "text")
    after = segments(s, d).select("job", F.when(F.col("idx") % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("text"))
    return corpus_audit.word_coverage(before, after)


def stage_rows(s, d):
    x = segments(s, d)
    a = x.select(F.lit("transcribe").alias("stage"), "job", "idx", "text")
    b = x.where("idx % 4 != 3").select(F.lit("translate").alias("stage"), "job", "idx", F.col("translated").alias("text"))
    return a.unionByName(b)


def runs(s, d):
    """Benchmark runs: (user, event type) as model and target."""
    e = table(s, d, "events")
    k = F.col("event_id")
    return e.select(
        (F.col("user_id") % 6).alias("model"),
        F.col("event_type").alias("target"),
        k.alias("run"),
        F.lit(9).alias("segments"),
        F.when(F.col("user_id") % 6 == 1, k % 3).otherwise(0).alias("fallback"),
        F.when((F.col("user_id") % 6 == 2) & (F.col("event_type") == "view"), 1).otherwise(0).alias("meta"),
        F.when(F.col("user_id") % 6 == 3, 0.9).otherwise(1.0).alias("script_ok"),
        F.when(F.col("event_type") == "error", 0.4).otherwise(1.0).alias("digits_kept"),
        F.col("value").alias("seconds"),
        F.lit(False).alias("failed"),
    )


_RUNS = """runs AS (SELECT user_id % 6 AS model, event_type AS target, event_id AS run, 9 AS segments, CASE WHEN user_id % 6 = 1 THEN event_id % 3 ELSE 0 END AS fallback,
    CASE WHEN user_id % 6 = 2 AND event_type = 'view' THEN 1 ELSE 0 END AS meta, CASE WHEN user_id % 6 = 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS script_ok,
    CASE WHEN event_type = 'error' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS digits_kept, value AS seconds FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY seconds, run) - 1 AS nth, count(*) OVER (PARTITION BY model, target) AS n FROM runs),
graded AS (SELECT model, target, CASE WHEN fallback > segments * 0.2 OR meta > 0 THEN 'unusable' WHEN fallback > 0 OR script_ok < 0.99 OR digits_kept < 0.5 THEN 'risky' ELSE 'good' END AS grade, median_seconds FROM (
    SELECT model, target, avg(fallback) AS fallback, max(segments) AS segments, avg(meta) AS meta, min(script_ok) AS script_ok, min(digits_kept) AS digits_kept, max(seconds) FILTER (nth = n // 2) AS median_seconds FROM ranked GROUP BY model, target))"""


def rules(s):
    return s.createDataFrame([("the", "check", "(?i)the", None), ("of not and", "check", "of", "xyzzy"), ("der", "check", "der", "die"), ("stop", "penalty", "[.]", None)], "rule string, kind string, expect string, reject string")


def vectors(s, d):
    return table(s, d, "embeddings")


def fingerprints(s, d):
    j = jobs(s, d)
    return j.select(F.col("id").alias("job"), "stage", corpus_audit.fingerprint([F.col("target_lang"), F.col("n_langs"), F.col("batch_id")], [F.when(F.col("id") % 9 != 0, F.col("target_lang"))], "v1").alias("fingerprint"))


def reuse(s, d):
    order = s.createDataFrame([(x,) for x in ("transcribe", "translate", "tts")], "stage string")
    f = fingerprints(s, d)
    return corpus_audit.reuse_plan(order, f, f.withColumn("job", -F.col("job")))


def upserted(s, d):
    j = jobs(s, d).select((F.col("id") % 500).alias("key"), F.col("id").alias("version"), "status", "target_lang")
    return corpus_audit.latest_by_key(j, "key", "version")


def glossary_miss(s, d):
    """A term in the source without its mapping in the target, once per term: the first segment by job and idx."""
    terms = s.createDataFrame([("the", "ZZ"), ("der", "ab"), ("la", "QQ"), ("de", "x")], "term string, mapped string")
    hit = flags.missed_terms(segments(s, d), terms, ["job", "idx"])
    return hit.groupBy("term").agg(F.min(F.struct("job", "idx")).alias("m"), F.count(F.lit(1)).alias("n")).select("term", "m.job", "m.idx", "n")


def settled_terms(s, d):
    """Terms of one to three words: the begins of all segments, each mapped to the word behind it."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    x = segments(s, d).select(words.alias("w"), (F.col("idx") % 3 + 1).cast("int").alias("n")).where("size(w) > n")
    return x.groupBy(F.lower(F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("term")).agg(F.min(F.lower(F.expr("w[n]"))).alias("mapped"))


def glossary_terms(s, d):
    hit = flags.missed_terms(segments(s, d), settled_terms(s, d), ["job", "idx"])
    return hit.groupBy("term", "mapped").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("job", "idx")).alias("m")).select("term", "mapped", "n", "m.job", "m.idx")


def names(s, d):
    """Names by number of documents: capitalised words seen in several."""
    x = docs(s, d).select("doc_id", F.explode(tx.source_names(F.col("text"), STOPWORDS)).alias("name"))
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 3")


def renderings(s, d):
    """Names with two renderings, where every second line of a job names its speaker in one of two ways."""
    x = segments(s, d)
    said = F.when(F.col("idx") % 4 == 0, "Kyoto").when(F.col("idx") % 4 == 2, "Kioto").otherwise("here")
    text = F.concat("text", F.lit(" in "), F.when(F.col("idx") % 2 == 0, "Kyoto").otherwise("here"))
    rows = x.select("job", "idx", "start_ms", text.alias("text"), F.concat(F.lit("auf "), said, F.lit(" ende")).alias("translated"))
    found = flags.inconsistent_names(rows, target="de", stopwords=STOPWORDS)
    return found.where("source_span = 'Kyoto'").select("job", "idx", "source_span", "target_span", F.array_join("variants", "|").alias("variants"))


def activity_recent(s, d):
    e = table(s, d, "events")
    return e.where(F.col("event_type").isin("error", "purchase") & (F.col("event_id") > 500)).orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


def log_levels(s, d):
    rank = F.when(F.col("event_type") == "error", 40).when(F.col("event_type") == "click", 30).when(F.col("event_type") == "view", 20).otherwise(99)
    return table(s, d, "events").where(rank >= 30).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _streamed(s, d, make, mode, *, files_per_batch=100):
    """Output rows of a query over ``events`` as a stream of files, run to its end; ``batch`` tells which batch gave a row."""
    where = folder(s, "stream")
    # A pattern, as the table may be one file or a folder of files, and a stream's plain path must be a folder.
    source = f"{d}/events.parque[t]"
    stream = make(activity.watch_folder(s, source, table(s, d, "events").schema, files_per_batch=files_per_batch))
    activity.run_available(stream, where, mode=mode)
    return s.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{where}/out")


def _complete(rows):
    """What the last batch gave: complete output repeats all rows in each batch."""
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last"), "left_semi").drop("batch")


def stream_daily(s, d, **options):
    return _complete(_streamed(s, d, activity.daily_usage, "complete", **options))


def stream_ring(s, d, **options):
    rows = _streamed(s, d, activity.ring, "update", **options)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("newest", "evicted"), F.col("batch")).alias("r")).select("user_id", F.array_join("r.newest", ",").alias("newest"), "r.evicted")


def stream_sessions(s, d, **options):
    """Open sessions too."""
    return _complete(_streamed(s, d, lambda e: activity.sessions(e, late=None), "complete", **options))


def rejections(s, d):
    """Why lines can't be translations into Russian: Latin ones and ones with Cyrillic tails, some with prose about the task."""
    front = F.when(F.col("idx") % 6 == 1, "Here is my translation: ").when(F.col("idx") % 6 == 2, "I'll translate ").otherwise("")
    tail = F.when(F.col("idx") % 2 == 0, F.repeat(F.lit(" словами"), F.floor(F.length("translated") / 8).cast("int") + 1)).otherwise("")
    rows = segments(s, d).withColumn("translated", F.when(F.col("translated") != "", F.concat(front, "translated", tail)).otherwise(""))
    return rows.select("job", "idx", tx.rejected(F.col("text"), F.col("translated"), language="ru").alias("why"))


def _logged(s, d):
    """The folder of a log and feed into which the error messages went as a stream."""
    where = folder(s, "log")
    stream = activity.watch_folder(s, f"{d}/events.parque[t]", table(s, d, "events").schema)
    log.run_log(_messages_of(stream), where, order=["event_id"], secret=["message"])
    return where


def stream_log(s, d):
    return s.read.parquet(f"{_logged(s, d)}/log").select("id", "event_id", "stage", "message")


def stream_feed(s, d):
    return log.feed(s, _logged(s, d)).select("id", "event_id")


def stream_issues(s, d):
    """Error messages as reports: the first of a signature opens an issue, later ones are comments."""
    where = folder(s, "issues")
    stream = _messages_of(activity.watch_folder(s, f"{d}/events.parque[t]", table(s, d, "events").schema))
    reports = stream.select("event_id", scalars.error_signature(F.col("stage"), F.substring("message", 1, 12)).alias("signature"))
    log.run_batches(reports, where, lambda batch, n: log.issue_batch(batch, n, where, order=["event_id"], title=F.concat(F.lit("[bug] "), "signature")))
    return s.read.parquet(f"{where}/deliveries").select("event_id", "signature", "issue", "action", "title")


QUERIES = {
    "translation_verdicts": rejections,
    "stream_log": stream_log,
    "stream_feed": stream_feed,
    "stream_issues": stream_issues,
    "redact": lambda s, d: messages(s, d).select("event_id", scalars.redact_secrets(F.col("message")).alias("message")),
    "error_signature": lambda s, d: messages(s, d).select("event_id", scalars.normalise_error(F.col("message")).alias("normal"), scalars.error_signature(F.col("stage"), F.col("message")).alias("signature")),
    "duration_parse": lambda s, d: durations(s, d).select("event_id", scalars.parse_duration(F.col("text")).alias("seconds")),
    "title_normalize": lambda s, d: docs(s, d).select("doc_id", scalars.normalise_title(F.col("text")).alias("title")),
    "script_ratio": lambda s, d: docs(s, d).select("doc_id", scalars.script_ratio(F.col("text"), tx.SCRIPTS["latin"]).alias("ratio")),
    "foreign_letters": lambda s, d: docs(s, d).select("doc_id", tx.foreign_letters(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "їжак ё").otherwise("")), "ru").alias("letters")),
    "source_bleed": lambda s, d: segments(s, d).select("job", "idx", F.size(tx.repeated_source_words(F.col("text"), F.col("translated"))).alias("repeated")),
    "translation_rejected": lambda s, d: segments(s, d).select("job", "idx", tx.rejected(F.col("text"), F.col("translated")).alias("why")),
    "word_boundary_contains": lambda s, d: docs(s, d).where(scalars.word_contains(F.col("text"), "the")).select("doc_id"),
    "cer": lambda s, d: segments(s, d).select("job", "idx", scalars.error_rate(F.col("translated"), F.col("text")).alias("cer")),
    "duplicate_score": duplicate_scores,
    "duplicate_titles": duplicate_titles,
    "names": names,
    "flags_inconsistent": renderings,
    "glossary_miss": glossary_miss,
    "glossary_terms": glossary_terms,
    "word_coverage": coverage,
    "stage_audit": lambda s, d: corpus_audit.stage_audit(stage_rows(s, d)),
    "missing_segments": lambda s, d: corpus_audit.missing(stage_rows(s, d).where("stage = 'transcribe'"), stage_rows(s, d).where("stage = 'translate'"), ["job", "idx"]),
    "dup_idx": lambda s, d: corpus_audit.duplicate_ids(stage_rows(s, d)),
    "benchmark_grades": lambda s, d: corpus_audit.grades(runs(s, d)),
    "decision_matrix": lambda s, d: corpus_audit.decision_matrix(corpus_audit.grades(runs(s, d)), ["click", "error", "purchase", "signup", "view"]),
    "checklist_score": lambda s, d: corpus_audit.checklist(docs(s, d).select(F.col("lang").alias("subject"), "text"), rules(s)),
    "speech_rate": lambda s, d: corpus_audit.speech_rate(docs(s, d).select("lang", "text", ((F.col("n_chars") % 90) + 10).cast("double").alias("seconds")), anchor="en"),
    "centroid": lambda s, d: corpus_audit.centroids(vectors(s, d), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x")),
    "greedy_match": lambda s, d: folds.greedy_pairs(all_profile_matches(s, d).select((F.col("vec_id") % 20).alias("grp"), F.col("vec_id").alias("a"), F.col("profile").alias("b"), "score")),
    "profile_assignment": lambda s, d: folds.greedy_pairs(all_profile_matches(s, d).select(F.floor(F.col("vec_id") / 25).alias("grp"), F.col("vec_id").alias("a"), F.col("profile").alias("b"), "score")),
    "stage_prints": lambda s, d: prints.stage_prints(print_inputs(s, d)),
    "stage_fingerprint": lambda s, d: fingerprints(s, d).groupBy("stage").agg(F.countDistinct("fingerprint").alias("distinct_prints"), F.count_if(F.col("fingerprint").isNull()).alias("without")),
    "reuse_plan": reuse,
    "upsert": upserted,
    "retention": lambda s, d: corpus_audit.retain(jobs(s, d), now=F.lit(NOW).cast("timestamp"), days=3, newest=2000).select("id"),
    "activity_recent": activity_recent,
    "log_level_filter": log_levels,
    "segment_merge": lambda s, d: folds.merge_continuations(segments(s, d), gap=300, longest=60_000, chars=900).select("job", "idx", "start_ms", "end_ms", "speaker"),
    "micro_absorb": lambda s, d: folds.absorb_tiny(segments(s, d), short=9000, chars=120).select("job", "idx", "start_ms", "end_ms", "speaker"),
    "segment_postprocess": lambda s, d: folds.postprocess(segments(s, d)).select("job", "idx", "start_ms", "end_ms", "speaker"),
    "cue_autofix": lambda s, d: folds.autofix_cues(segments(s, d).select("job", "idx", "start_ms", "end_ms", "text"), lines=3, cps=14.0),
    "reference_chunks": lambda s, d: folds.reference_chunks(segments(s, d)),
    "sentences": lambda s, d: docs(s, d).select("doc_id", F.size(tx.sentences(F.col("text"))).alias("sentences")),
    "stream_usage_daily": stream_daily,
    "stream_ring": stream_ring,
    "stream_sessions": stream_sessions,
}


def all_profile_matches(s, d):
    """All vectors against the centroids of all, by label."""
    p = corpus_audit.centroids(vectors(s, d), "label", "embedding")
    return corpus_audit.profile_scores(vectors(s, d), p).select("vec_id", F.col("label").alias("profile"), F.round("score", 6).alias("score")).where("score >= 0.1")


QUERIES["cosine_topk"] = all_profile_matches

_UNIT = "list_transform({v}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))"
_CENTROIDS = """u AS (SELECT vec_id, label, unnest({unit}) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings {where}),
    m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY label, pos), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label),
    c AS (SELECT label, pos, x / n AS x FROM m JOIN n USING (label))"""

ORACLES = {
    "foreign_letters": "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text || CASE WHEN doc_id % 3 = 0 THEN 'їжак ё' ELSE '' END), '[іїєґ]'))), '') AS letters FROM documents",
    "missing_segments": f"WITH {SEGMENTS_SQL}, t AS (SELECT job, idx FROM segments WHERE idx % 4 != 3) SELECT DISTINCT job, idx FROM segments s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job = s.job AND t.idx = s.idx)",
    "dup_idx": f"WITH {SEGMENTS_SQL}, r AS (SELECT job, idx FROM segments UNION ALL SELECT job, idx FROM segments WHERE idx % 4 != 3) SELECT job, idx, count(*) AS n FROM r GROUP BY job, idx HAVING count(*) > 1",
    "translation_verdicts": f"""WITH {SEGMENTS_SQL}, r AS (SELECT job, idx, text, CASE WHEN translated != '' THEN CASE idx % 6 WHEN 1 THEN 'Here is my translation: ' WHEN 2 THEN 'I''ll translate ' ELSE '' END || translated
              || CASE WHEN idx % 2 = 0 THEN repeat(' словами', (length(translated) // 8 + 1)::INTEGER) ELSE '' END ELSE '' END AS t FROM segments),
        l AS (SELECT *, length(regexp_replace(t, '\\PL+', '', 'g')) AS letters, length(regexp_replace(t, '[^\\x{{0400}}-\\x{{052F}}]+', '', 'g')) AS inside FROM r)
        SELECT job, idx, CASE WHEN length(trim(t)) = 0 THEN 'empty' WHEN length(trim(t)) > greatest(80, length(text) * 5) THEN 'too long' WHEN regexp_matches(t, '(?i)here(''s| is) (the|my) translation|i(''ll| will| can) translate') THEN 'prose about the task'
               WHEN letters >= 8 AND inside < letters * 0.3::DOUBLE THEN 'wrong script' END AS why FROM l""",
    "redact": f"WITH {_MESSAGES} SELECT event_id, regexp_replace(regexp_replace(message, '\\bhf_[A-Za-z0-9]{{8,}}', '[redacted]', 'g'), '(?i)((?:token|secret|api[_-]?key|password|authorization)\\s*[=:]\\s*)([^\\s\"'',}}]{{4,}})', '\\1[redacted]', 'g') AS message FROM messages",
    "error_signature": f"""WITH {_MESSAGES}, l AS (SELECT event_id, stage, lower(message) AS m FROM messages),
        n AS (SELECT event_id, stage, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?:/[\\w.@-]+){{2,}}', '<path>', 'g'), '\\b[0-9a-f]{{8,}}\\b', '<hex>', 'g'), '0x[0-9a-f]+', '<hex>', 'g'),
            '\\b\\d+(?:\\.\\d+)?', '<n>', 'g'), '\\s+', ' ', 'g')), 300) AS normal FROM l)
        SELECT event_id, normal, left(sha256(stage || '|' || normal), 12) AS signature FROM n""",
    "script_ratio": """WITH l AS (SELECT doc_id, regexp_replace(text, '\\PL+', '', 'g') AS l FROM documents)
        SELECT doc_id, CASE WHEN length(l) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(l, '[^A-Za-z\\x{00C0}-\\x{024F}]+', '', 'g')) / length(l) END AS ratio FROM l""",
    "translation_rejected": f"""WITH {SEGMENTS_SQL} SELECT job, idx, CASE WHEN length(trim(translated)) = 0 THEN 'empty' WHEN length(trim(translated)) > greatest(80, length(text) * 5) THEN 'too long' END AS why FROM segments""",
    "word_boundary_contains": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|\\PL)the(\\PL|$)')",
    "stream_sessions": """WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS fresh FROM events),
        n AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM l)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM n GROUP BY user_id, nth""",
    "names": """WITH w AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '\\b[A-Z][A-Za-z’''-]{2,}'), lambda x: regexp_replace(x, '(?i)(.)[’''](?:s|m|d|t|re|ve|ll)$', '\\1')))) AS name FROM documents)
        SELECT name, count(*) AS n, min(doc_id) AS first_doc FROM w WHERE length(name) >= 3 AND name != upper(name) AND lower(name) NOT IN ('the', 'and', 'for', 'der', 'die', 'les', 'los', 'las') GROUP BY name HAVING count(*) >= 3""",
    "reference_chunks": f"""WITH {SEGMENTS_SQL}, p AS (SELECT job, speaker, start_ms, start_ms + least(end_ms - start_ms, 15000) AS end_ms, least(end_ms - start_ms, 15000) AS ms,
            CASE WHEN end_ms - start_ms BETWEEN 1500 AND 12000 THEN 0 WHEN end_ms - start_ms > 12000 THEN 2 WHEN end_ms - start_ms >= 400 THEN 1 END AS turn FROM segments),
        b AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY job, speaker, turn ORDER BY ms DESC, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
        a0 AS (SELECT * FROM b WHERE turn = 0 AND before < 30000), t0 AS (SELECT job, speaker, sum(ms) AS total FROM a0 GROUP BY ALL),
        a1 AS (SELECT b.* FROM b LEFT JOIN t0 USING (job, speaker) WHERE turn = 1 AND coalesce(total, 0) < 6000 AND coalesce(total, 0) + before < 30000),
        t1 AS (SELECT job, speaker, sum(ms) AS total FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1) GROUP BY ALL),
        a2 AS (SELECT b.* FROM b LEFT JOIN t1 USING (job, speaker) WHERE turn = 2 AND coalesce(total, 0) < 6000 AND coalesce(total, 0) + before < 30000)
        SELECT job, speaker, start_ms, end_ms FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2)""",
    # DuckDB's levenshtein counts bytes. Over letters of one byte each it counts code points: the k-th letter of a
    # pair's own alphabet is written as the k-th such letter. A pair's alphabet has at most 127 letters here; a longer one gives null.
    "cer": f"""WITH {SEGMENTS_SQL}, l AS (SELECT job, idx, text, translated, list_sort(list_distinct(string_split(text || translated, ''))) AS letters FROM segments),
        m AS (SELECT *, length(text) AS a, length(translated) AS b, CASE WHEN len(letters) < 128 THEN
                  levenshtein(array_to_string(list_transform(string_split(translated, ''), lambda x: chr(list_position(letters, x)::INTEGER)), ''),
                              array_to_string(list_transform(string_split(text, ''), lambda x: chr(list_position(letters, x)::INTEGER)), '')) END AS d FROM l)
        SELECT job, idx, CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN 0.0 ELSE 1.0 END::DOUBLE WHEN b = 0 THEN 1.0::DOUBLE ELSE d / greatest(a, b) END AS cer FROM m""",
    "flags_inconsistent": f"""WITH {SEGMENTS_SQL}, n AS (SELECT job, count(*) FILTER (idx % 4 = 0) AS same, count(*) FILTER (idx % 4 = 2) AS other FROM segments GROUP BY job)
        SELECT job, 0::BIGINT AS idx, 'Kyoto' AS source_span, 'Kyoto' AS target_span, 'Kyoto|Kioto' AS variants FROM n WHERE same > 0 AND other > 0""",
    "greedy_match": f"""WITH RECURSIVE {_CENTROIDS.format(unit=_UNIT.format(v='embedding'), where='')}, p AS (SELECT label AS profile, list(x ORDER BY pos) AS centroid FROM c GROUP BY label),
        s AS (SELECT vec_id % 20 AS grp, vec_id AS a, profile AS b, round(list_inner_product({_UNIT.format(v='embedding')}, {_UNIT.format(v='centroid')}), 6) AS score FROM embeddings, p),
        k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, a, b) AS nth FROM s WHERE score >= 0.1),
        f AS (SELECT grp, nth, [a] AS left_, [b] AS right_, a, b, score FROM k WHERE nth = 1
              UNION ALL (SELECT k.grp, k.nth, list_append(f.left_, k.a), list_append(f.right_, k.b), k.a, k.b, k.score FROM f JOIN k ON k.grp = f.grp AND k.nth > f.nth AND NOT list_contains(f.left_, k.a) AND NOT list_contains(f.right_, k.b)
                         QUALIFY row_number() OVER (PARTITION BY k.grp ORDER BY k.nth) = 1))
        SELECT grp, a, b::BIGINT AS b, score FROM f""",
    "profile_assignment": f"""WITH RECURSIVE {_CENTROIDS.format(unit=_UNIT.format(v='embedding'), where='')}, p AS (SELECT label AS profile, list(x ORDER BY pos) AS centroid FROM c GROUP BY label),
        s AS (SELECT vec_id // 25 AS grp, vec_id AS a, profile AS b, round(list_inner_product({_UNIT.format(v='embedding')}, {_UNIT.format(v='centroid')}), 6) AS score FROM embeddings, p),
        k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, a, b) AS nth FROM s WHERE score >= 0.1),
        f AS (SELECT grp, nth, [a] AS left_, [b] AS right_, a, b, score FROM k WHERE nth = 1
              UNION ALL (SELECT k.grp, k.nth, list_append(f.left_, k.a), list_append(f.right_, k.b), k.a, k.b, k.score FROM f JOIN k ON k.grp = f.grp AND k.nth > f.nth AND NOT list_contains(f.left_, k.a) AND NOT list_contains(f.right_, k.b)
                         QUALIFY row_number() OVER (PARTITION BY k.grp ORDER BY k.nth) = 1))
        SELECT grp, a, b::BIGINT AS b, score FROM f""",
    "duration_parse": """WITH t AS (SELECT event_id, event_id AS k FROM events) SELECT event_id, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN (k % 60) * 60 + 7 WHEN 2 THEN (k % 9) * 3600 + 720 + (k % 50 + 10) END AS seconds FROM t""",
    "title_normalize": "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')) AS title FROM documents",
    "source_bleed": f"""WITH {SEGMENTS_SQL} SELECT job, idx, len(list_filter(list_intersect(list_distinct(regexp_extract_all(lower(translated), '[\\pL\\pN_]{{5,}}')), list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{{5,}}'))), lambda w: NOT regexp_matches(w, '[0-9]')))::INTEGER AS repeated FROM segments""",
    "word_coverage": f"""WITH {SEGMENTS_SQL}, a AS (SELECT job, w, count(*) AS n FROM (SELECT job, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS w FROM segments) GROUP BY job, w),
        b AS (SELECT job, w, count(*) AS m FROM (SELECT job, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS w FROM segments WHERE idx % 5 != 4) GROUP BY job, w),
        g AS (SELECT job, sum(n)::BIGINT AS words, sum(greatest(n - coalesce(m, 0), 0))::BIGINT AS lost FROM a LEFT JOIN b USING (job, w) GROUP BY job)
        SELECT job, words, lost, lost / words * 100.0::DOUBLE AS lost_pct, CASE WHEN lost / words * 100.0::DOUBLE >= 0.5 THEN 'loss' WHEN lost > 0 THEN 'warn' ELSE 'info' END AS severity FROM g""",
    "stage_audit": f"""WITH {SEGMENTS_SQL}, r AS (SELECT 'transcribe' AS stage, job, idx, text FROM segments UNION ALL SELECT 'translate', job, idx, translated FROM segments WHERE idx % 4 != 3)
        SELECT stage, count(*) AS segments, count(DISTINCT (job, idx)) AS unique_segments, sum(len(regexp_extract_all(lower(text), '[\\pL\\pN_]+')))::BIGINT AS words FROM r GROUP BY stage""",
    "benchmark_grades": f"WITH {_RUNS} SELECT * FROM graded",
    "decision_matrix": f"WITH {_RUNS} SELECT model, max(grade) FILTER (target = 'click') AS click, max(grade) FILTER (target = 'error') AS error, max(grade) FILTER (target = 'purchase') AS purchase, max(grade) FILTER (target = 'signup') AS signup, max(grade) FILTER (target = 'view') AS view FROM graded GROUP BY model",
    "checklist_score": """SELECT lang AS subject, (count(*) FILTER (regexp_matches(text, '(?i)the')) + count(*) FILTER (regexp_matches(text, 'of') AND NOT regexp_matches(text, 'xyzzy')) + count(*) FILTER (regexp_matches(text, 'der') AND NOT regexp_matches(text, 'die')))::BIGINT AS passed,
        count(*) * 3 AS total, sum(length(text) - length(replace(text, '.', '')))::BIGINT AS penalty_hits FROM documents GROUP BY lang""",
    "speech_rate": """WITH o AS (SELECT lang, text, min((n_chars % 90) + 10)::DOUBLE AS seconds FROM documents GROUP BY lang, text), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, text) AS nth FROM o),
        m AS (SELECT lang, median(length(text) / seconds) AS rate, count(*) AS samples FROM r WHERE nth <= 8 GROUP BY lang)
        SELECT lang, rate, samples, rate / (SELECT rate FROM m WHERE lang = 'en') AS scale FROM m""",
    "centroid": f"WITH {_CENTROIDS.format(unit=_UNIT.format(v='embedding'), where='')} SELECT label, pos::INTEGER AS pos, round(x, 6) AS x FROM c",
    "cosine_topk": f"""WITH {_CENTROIDS.format(unit=_UNIT.format(v='embedding'), where='')}, p AS (SELECT label AS profile, list(x ORDER BY pos) AS centroid FROM c GROUP BY label),
        s AS (SELECT vec_id, profile, round(list_inner_product({_UNIT.format(v='embedding')}, {_UNIT.format(v='centroid')}), 6) AS score FROM embeddings, p) SELECT * FROM s WHERE score >= 0.1""",
    "upsert": f"WITH {JOBS_SQL}, r AS (SELECT id % 500 AS key, id AS version, status, target_lang, row_number() OVER (PARTITION BY id % 500 ORDER BY id DESC) AS nth FROM jobs) SELECT key, version, status, target_lang FROM r WHERE nth = 1",
    "retention": f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE created >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY OR id > (SELECT max(id) FROM jobs) - 2000",
    "activity_recent": "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'purchase') AND event_id > 500 ORDER BY event_id DESC LIMIT 100",
    "log_level_filter": "SELECT event_type, count(*) AS n FROM events WHERE event_type != 'view' GROUP BY event_type",
    "reuse_plan": f"""WITH {JOBS_SQL}, f AS (SELECT id AS job, stage, CASE WHEN id % 9 != 0 THEN concat_ws('|', target_lang, n_langs, batch_id) END AS print FROM jobs)
        SELECT job, stage, print IS NOT NULL AS known, print IS NOT NULL AS hit FROM f WHERE stage IN ('transcribe', 'translate', 'tts')""",
    "stage_fingerprint": f"""WITH {JOBS_SQL} SELECT stage, count(DISTINCT CASE WHEN id % 9 != 0 THEN concat_ws('|', target_lang, n_langs, batch_id) END) AS distinct_prints, count(*) FILTER (id % 9 = 0) AS without FROM jobs GROUP BY stage""",
    "glossary_miss": f"""WITH {SEGMENTS_SQL}, t(term, mapped) AS (VALUES ('the', 'zz'), ('der', 'ab'), ('la', 'qq'), ('de', 'x')),
        l AS (SELECT job, idx, ' ' || lower(regexp_replace(text, '[^\\pL]+', ' ', 'g')) || ' ' AS a, ' ' || lower(regexp_replace(translated, '[^\\pL]+', ' ', 'g')) || ' ' AS b FROM segments WHERE trim(translated) != ''),
        h AS (SELECT term, job, idx FROM l, t WHERE contains(a, ' ' || term || ' ') AND NOT contains(b, ' ' || mapped || ' '))
        SELECT term, min(job * 1000 + idx) // 1000 AS job, min(job * 1000 + idx) % 1000 AS idx, count(*) AS n FROM h GROUP BY term""",
    "stream_log": f"""WITH {_MESSAGES} SELECT row_number() OVER (ORDER BY event_id) AS id, event_id, stage,
        regexp_replace(regexp_replace(message, '\\bhf_[A-Za-z0-9]{{8,}}', '[redacted]', 'g'), '(?i)((?:token|secret|api[_-]?key|password|authorization)\\s*[=:]\\s*)([^\\s\"'',}}]{{4,}})', '\\1[redacted]', 'g') AS message FROM messages""",
    "stream_feed": "WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS id, event_id FROM events) SELECT id, event_id FROM r ORDER BY id DESC LIMIT 600",
    "stream_issues": f"""WITH {_MESSAGES}, s AS (SELECT event_id, left(sha256(stage || '|' || trim(lower(left(message, 12)))), 12) AS signature FROM messages),
        f AS (SELECT *, min(event_id) OVER (PARTITION BY signature) AS first_id FROM s)
        SELECT event_id, signature, 'issue-' || first_id AS issue, CASE WHEN event_id = first_id THEN 'created' ELSE 'commented' END AS action, CASE WHEN event_id = first_id THEN '[bug] ' || signature END AS title FROM f""",
    "stage_prints": f"""WITH {SEGMENTS_SQL}, r AS (SELECT job, arg_min(text, idx) AS prompt, '[' || string_agg('[' || round(start_ms / 1000.0, 3)::DOUBLE || ',' || round(end_ms / 1000.0, 3)::DOUBLE || ',' || to_json(trim(text)) || ']', ',' ORDER BY idx) || ']' AS heard,
              '[' || string_agg('[' || round(start_ms / 1000.0, 3)::DOUBLE || ',' || to_json(trim(coalesce(nullif(translated, ''), text))) || ',"' || speaker || '"]', ',' ORDER BY idx) || ']' AS said FROM segments GROUP BY job),
        i AS (SELECT *, '"source_fingerprint":"' || sha256(job::VARCHAR) || '"' AS src, sha256(heard) AS heard_print, sha256(said) AS said_print, CASE WHEN job % 2 = 0 THEN 'true' ELSE 'false' END AS denoise FROM r),
        e AS (SELECT *, sha256('{{"__stage":"download","__version":1,' || src || '}}') AS p1,
                     sha256('{{"__stage":"extract","__version":1,"auto_denoise":' || denoise || ',"keep_bg":null,' || src || ',"vad_enabled":true,"vad_threshold":' || (job % 8) / 16.0::DOUBLE || '}}') AS p2 FROM i),
        a AS (SELECT *, sha256('{{"__stage":"transcribe","__version":1,"asr_backend":null,"audio_fingerprint":"' || p2 || '","initial_prompt":' || to_json(prompt) || ',"source_lang":null,"whisper_model":"m\\"1"}}') AS p3,
                     sha256('{{"__stage":"diarize","__version":1,"audio_fingerprint":"' || p2 || '","diarization_model":null,"max_speakers":null,"min_speakers":' || CASE WHEN job % 3 = 0 THEN job::VARCHAR ELSE 'null' END
                         || ',"reference_audio_fingerprint":"none","same_language":null,"skip_diarization":null,"speaker_mode":null}}') AS p4,
                     CASE WHEN job % 7 != 0 THEN sha256('{{"__stage":"translate","__version":2,"context_hint":null,"glossary_fingerprint":"g","model":null,"segments_fingerprint":"' || heard_print || '","target_lang":"de"}}') END AS p5,
                     sha256('{{"__stage":"tts","__version":1,"speaker_refs_fingerprint":"r","target_lang":"de","translation_fingerprint":"' || said_print || '","tts_engine":null,"tts_speed":null,"voice_preset":null,"voice_seed":null,"voice_style":null}}') AS p6 FROM e)
        SELECT job, unnest(['download', 'extract', 'transcribe', 'diarize', 'translate', 'tts']) AS stage, unnest([p1, p2, p3, p4, p5, p6]) AS fingerprint FROM a""",
    "glossary_terms": f"""WITH {SEGMENTS_SQL}, w AS (SELECT regexp_extract_all(text, '\\pL+') AS w, idx % 3 + 1 AS n FROM segments),
        t AS (SELECT lower(array_to_string(w[1:n], ' ')) AS term, min(lower(w[n + 1])) AS mapped FROM w WHERE len(w) > n GROUP BY 1),
        l AS (SELECT job, idx, lower(text) AS low, ' ' || regexp_replace(lower(text), '\\PL+', ' ', 'g') || ' ' AS a, ' ' || regexp_replace(lower(translated), '\\PL+', ' ', 'g') || ' ' AS b FROM segments WHERE trim(translated) != ''),
        c AS MATERIALIZED (SELECT * FROM l JOIN t ON contains(a, ' ' || term || ' ') AND NOT contains(b, ' ' || mapped || ' ')),
        h AS (SELECT * FROM c WHERE NOT contains(term, ' ') OR regexp_matches(low, '(^|\\PL)' || term || '(\\PL|$)'))
        SELECT term, mapped, count(*) AS n, min(job * 1000 + idx) // 1000 AS job, min(job * 1000 + idx) % 1000 AS idx FROM h GROUP BY term, mapped""",
    "stream_usage_daily": "SELECT strftime(ts, '%Y-%m-%d') AS bucket, sum(CAST(value AS DECIMAL(18,3)))::DOUBLE AS minutes, count(*) AS jobs FROM events GROUP BY 1",
    "stream_ring": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS newest, greatest(max(n) - 4, 0) AS evicted FROM r WHERE nth <= 4 GROUP BY user_id",
}
