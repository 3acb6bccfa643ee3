"""Queries of intake, records, gates, measurements and flags, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx
from cuemill.operators import corpus_audit, flags, folds, intake, workbench
from cuemill.sources import scratch, store, tail
from cuemill.sources.standin import JOBS_SQL, NOW, SEGMENTS_SQL, jobs, segments, table

#: Outputs of failed downloads, the shape and the class of each, and its error line's begin.
OUTPUTS = [
    ("WARNING: x\nERROR: [a] Private video. Sign in if you've been granted access", "gone", "unknown"),
    ("ERROR: Sign in to confirm you’re not a bot. HTTP Error 403: Forbidden", "bot-check", "bot-check"),
    ("ERROR: Sign in to confirm your age", "age-gate", "age-gate"),
    ("ERROR: The uploader has not made this video available in your country", "geo-block", "geo-block"),
    ("WARNING: nsig extraction failed: Some formats may be missing\nERROR: Requested format is not available", "challenge-unsolved", "format"),
    ("ERROR: Requested format is not available", "format-unavailable", "format"),
    ("ERROR: Unable to download: timed out", "network", "network"),
    ("ERROR: unable to download video data: HTTP Error 403: Forbidden", "forbidden", "persistent-403"),
    ("something else", "unknown", "unknown"),
    ("", "unknown", "unknown"),
    ("WARNING: 1 of 2\n\t  ERROR: 0 first 1 \r\n  ERROR: 2nd HTTP Error 403: Forbidden 2  \n 3 more", "forbidden", "persistent-403"),
    ("[x] Solving\nWARNING: [x] n challenge solving failed: Some formats may be missing.\n 2 ERROR: no\nERROR: [x] 1: Requested format is not available. Use --list-formats", "challenge-unsolved", "format"),
    ("ERROR: HTTP Error 403: Forbidden\n  ERROR: Sign in to confirm you're not a bot.", "bot-check", "bot-check"),
    (" \t\n ", "unknown", "unknown"),
    (" 1 " + "long line " * 40 + "\n 9 ", "unknown", "unknown"),
]
STOPWORDS = ["the", "and", "for", "that", "this", "are", "was", "with", "from"]


def _quoted(values):
    texts = (str(v).replace("'", "''") for v in values)
    for letter in "\n\r\t":
        texts = [t.replace(letter, f"' || chr({ord(letter)}) || '") for t in texts]
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def _pick(values, k):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int"))


def events(s, d):
    return table(s, d, "events")


def failed(s, d):
    k = F.col("event_id")
    source = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("https://v/watch?v="), k))
    return events(s, d).select("event_id", _pick([o for o, *_ in OUTPUTS], k).alias("stderr"), F.when(k % 20 == 19, "tail of stdout").otherwise("").alias("stdout"), source.alias("source"))


_FAILED = f"""printed AS (SELECT event_id, {_quoted(o for o, *_ in OUTPUTS)}[event_id % {len(OUTPUTS)} + 1] AS stderr, CASE WHEN event_id % 20 = 19 THEN 'tail of stdout' ELSE '' END AS stdout,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://v/watch?v=' || event_id END AS source FROM events),
failed AS (SELECT *, regexp_replace(stderr, '^\\s+|\\s+$', '', 'g') AS shown, list_filter(list_transform(string_split_regex(stderr, '\\r\\n|\\n|\\r'),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, 'ERROR:')) AS errors FROM printed)"""


def download_failures(s, d):
    blob = scalars.output_blob(F.col("stderr"), F.col("stdout"))
    name = scalars.failure_class(blob, scalars.DOWNLOAD_CLASSES)
    return failed(s, d).select("event_id", name.alias("failure_class"), scalars.error_detail(F.col("stderr")).alias("detail"), F.array_join(scalars.rescue_commands(name, F.col("source")), "; ").alias("commands"))


def _commands_sql():
    cases = []
    for kind, keys in scalars.CLASS_COMMANDS.items():
        text = "; ".join(scalars.COMMANDS[k] for k in keys).replace("'", "''")
        cases.append(f"WHEN '{kind}' THEN replace('{text}', '{{}}', q)")
    return " ".join(cases)


def infos(s, d):
    """A document as a video's metadata: its words are tags and chapters."""
    words = F.split("text", " ")
    return table(s, d, "documents").select(
        "doc_id", F.concat_ws(" ", "source", F.when(F.col("doc_id") % 7 == 0, "Official Video")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("channel"),
        F.col("source").alias("uploader"), words.alias("tags"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Music"))).alias("categories"),
        F.when(F.col("doc_id") % 11 == 0, "x").alias("artist"), F.lit(None).cast("string").alias("track"), F.col("text").alias("description"),
        F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("start_time"), p.alias("title"))).alias("chapters"),
    )


def curated(s, d):
    rows = intake.curate(infos(s, d))
    return rows.select("doc_id", "title", "channel", F.size("tags").alias("n_tags"), F.md5(F.array_join("tags", "|")).alias("tags"), F.md5("description").alias("description"), F.size("chapters").alias("chapters"), F.element_at(F.col("chapters.start"), -1).alias("last_start"), "is_music")


def published(s, d):
    k = F.col("doc_id")
    rows = table(s, d, "documents").select(
        k.alias("id"), F.when(k % 3 == 0, F.col("text")).alias("new_title"), F.when(k % 4 != 0, F.col("source")).alias("title"), F.lit(" ").alias("source_label"),
        F.when(k % 2 == 0, "http://a/b").otherwise("/home/x.mp4").alias("source"), F.when(k % 5 == 0, "http://page").alias("webpage_url"),
        F.when(k % 6 == 0, F.split("text", " ")).otherwise(F.array().cast("array<string>")).alias("new_tags"), F.array(F.col("lang")).alias("tags"), F.when(k % 2 == 1, F.col("text")).alias("new_description"),
    )
    return intake.publish_meta(rows).select("id", F.md5("title").alias("title"), F.md5("description").alias("description"), F.array_join("tags", "|").alias("tags"), "is_private")


def feed(s, d):
    k = F.col("event_id")
    return events(s, d).select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.when(k % 3 == 0, "3:09").when(k % 3 == 1, k.cast("string")).otherwise("live").alias("duration"),
        F.floor("value").cast("string").alias("view_count"), k.cast("string").alias("rank"), F.when(k % 4 == 0, "10").otherwise("x").alias("category_id"),
    )


def candidate_details(s, d):
    k = F.col("event_id")
    short = _pick(["0", "1", "", "false", "None", "0"], k)
    raw = feed(s, d).withColumn("event_id", F.col("rank").cast("long")).withColumns({"channel_title": F.when(k % 7 != 0, F.concat(F.lit("ch "), "id")), "rank_delta": F.when(k % 4 != 1, (k % 11 - 5).cast("string")).otherwise("n/a"), "is_short": short, "thumb_url": F.lit(None).cast("string")})
    return intake.candidate_details(raw).select("video_id", "channel", "rank_delta", "is_short", "rank")


def first_jobs(s, d):
    done = jobs(s, d).where("status = 'complete'").select(F.col("batch_id").alias("user_id"), "id")
    return intake.first_match(events(s, d).select("event_id", "user_id"), done, "user_id", "id", "id")


def gate_jobs(s, d):
    k = F.col("event_id")
    return events(s, d).select(
        k.alias("id"), F.when(k % 3 == 0, F.create_map(F.lit("subtitles"), F.lit("on"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("explicit"),
        F.when(k % 4 == 1, "review_voices").when(k % 4 == 2, "").when(k % 4 == 3, "auto").alias("wizard_mode"),
        F.create_map(F.lit("transcript"), F.lit("flagged_only"), F.lit("final_qc"), F.lit("odd")).alias("defaults"),
        F.array(F.lit("transcript"), F.lit("translation"), F.lit("subtitles"), F.lit("final_qc")).alias("cleared"),
        _pick(["transcribe", "translate", "tts", "merge", "unknown"], k).alias("stage"),
    )


def gates(s, d):
    rows = intake.resolved_gates(gate_jobs(s, d))
    return rows.select("id", *[F.element_at("gates", g).alias(g) for g in intake.GATES])


def quality_rows(s, d):
    return segments(s, d).select("job", "text", "translated", F.when(F.col("measured"), F.col("cer")).alias("word_conf"), "no_speech", F.when(F.col("tier") != 2, "a.wav").alias("audio"), F.when(F.col("measured"), F.col("cer")).alias("qa_score"))


def confidences(s, d):
    words = F.transform(F.sequence(F.lit(1), F.col("turn") + 1), lambda i: F.struct(F.when(i % 4 != 0, (i * 7 % 16) / F.lit(16.0)).alias("probability")))
    words = F.when(F.col("turn") % 3 != 2, words).otherwise(F.array().cast("array<struct<probability:double>>"))
    return table(s, d, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("idx"), intake.word_confidence(words).alias("w")).select("job", "idx", F.col("w.mean").alias("word_conf_mean"), F.col("w.least").alias("word_conf_min"))


def runs(s, d):
    tail = F.when(F.col("idx") % 3 == 0, " 40 и ещё немного слов").when(F.col("idx") % 3 == 1, ". Here is the translation").otherwise(" 7")
    return segments(s, d).select(F.col("job").alias("run"), F.concat("text", F.lit(" 123")).alias("text"), F.when(F.col("idx") % 5 == 4, F.concat("text", F.lit(" 123"))).otherwise(F.concat("translated", tail)).alias("translated"))


_RUNS = """runs AS (SELECT job AS run, text || ' 123' AS text, CASE WHEN idx % 5 = 4 THEN text || ' 123' ELSE translated || CASE idx % 3 WHEN 0 THEN ' 40 и ещё немного слов' WHEN 1 THEN '. Here is the translation' ELSE ' 7' END END AS translated FROM segments)"""


def languages(s, d):
    """The languages of documents, and others for every second one, with rates as documents show them (not for French)."""
    docs = table(s, d, "documents")
    other = _pick(["ja", "zh-CN", "hi", "xx", "ko-KR", "th"], F.floor(F.col("doc_id") / 2))
    names = docs.select(F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-XX"))).otherwise(other).alias("lang")).distinct()
    spoken = docs.where("lang != 'fr'").select("lang", "text", ((F.col("n_chars") % 90) + 10).cast("double").alias("seconds"))
    rates = corpus_audit.speech_rate(spoken, anchor="en")
    return intake.speech_rates(names, rates.select(F.col("lang").alias("code"), "rate"))


def reports(s, d):
    j = jobs(s, d)
    last = F.when(F.col("id") % 2 == 0, F.struct(F.lit("tts").alias("stage"), F.concat(F.col("error"), F.lit(" token=abcdef")).alias("message")))
    rows = j.where("error IS NOT NULL").select("id", "status", "target_lang", "error", F.col("stage").alias("failed_stage"), last.alias("last_error"), F.concat(F.lit("https://u?api_key="), "id", F.lit("zzzz")).alias("source"))
    return intake.bug_report(rows)


def payloads(s, d):
    rows = jobs(s, d).select("id", "status", F.when(F.col("id") % 2 == 0, F.lit("")).alias("title"), F.col("stage").alias("source_label"), "target_lang", F.col("minutes").cast("double").alias("duration"), "batch_id")
    fields = "job_id long, title string, duration_sec double, status string, target_lang string, batch_id long"
    return intake.payload(rows).select("job_id", F.from_json("payload", fields).alias("p")).select("job_id", "p.title", "p.duration_sec", "p.status", "p.target_lang", "p.batch_id")


def key_rows(s, d):
    c = table(s, d, "customer")
    salt = F.concat(F.lit("salt"), (F.col("c_custkey") % 5).cast("string"))
    token = F.concat(F.lit("gcd_"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("key_id"), "c_name", salt.alias("salt"), scalars.salted_hash(token, salt).alias("hash"), (F.col("c_custkey") % 7 == 0).alias("revoked"), F.when(F.col("c_custkey") % 4 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires"))


def tokens_verified(s, d):
    """Tokens of suppliers against the keys of the 25 nations' numbers: a table of fixed size."""
    tokens = table(s, d, "supplier").select(F.concat(F.lit("gcd_"), F.col("s_suppkey").cast("string")).alias("token"))
    small = table(s, d, "nation").select(F.col("n_nationkey").alias("c_custkey"))
    salt, token = F.concat(F.lit("salt"), (F.col("c_custkey") % 5).cast("string")), F.concat(F.lit("gcd_"), F.col("c_custkey").cast("string"))
    keys = small.select(F.col("c_custkey").alias("key_id"), salt.alias("salt"), scalars.salted_hash(token, salt).alias("hash"), (F.col("c_custkey") % 7 == 0).alias("revoked"), F.when(F.col("c_custkey") % 4 == 0, F.lit("2020-01-01").cast("timestamp")).alias("expires"))
    return intake.verified(tokens, keys, F.lit(NOW).cast("timestamp"))


def flag_rows(s, d):
    """Lines with a name in them, in Latin in some and in Cyrillic letters in others, and a term."""
    x = segments(s, d)
    name = _pick(["Marvin", "Ottilie", "Bertram"], F.col("job"))
    other = _pick(["Марвин", "Оттилия", "Бертрам"], F.col("job"))
    text = F.concat(F.col("text"), F.lit(" said "), name, F.lit(" again"))
    translated = F.concat(F.lit("тогда "), F.when(F.col("idx") % 3 == 0, name).otherwise(other), F.lit(" снова "), F.col("idx").cast("string"))
    return x.select("job", "idx", "start_ms", text.alias("text"), translated.alias("translated"), F.col("cer").alias("conf_mean"), F.col("no_speech").alias("conf_min"), "logprob")


def terms(s):
    return s.createDataFrame([("again", "опять"), ("said", "тогда")], "term string, mapped string")


def flags_shown(s, d):
    x = flag_rows(s, d)
    names = flags.inconsistent_names(x, target="ru", stopwords=STOPWORDS)
    latin = flags.untransliterated_names(x, source="en", target="ru", stopwords=STOPWORDS, brands=["youtube"])
    rows = flags.shown(names, flags.glossary_misses(x, terms(s)), latin, flags.unclear(x))
    return rows.select("job", "rank", "idx", "kind", "reason", "score", "source_span", "target_span", F.array_join("variants", "|").alias("variants"))


def synth_retry(s, d):
    old = segments(s, d).select("job", "idx", "translated", "speaker", F.when(F.col("tier") != 3, "a.wav").alias("audio"))
    new = segments(s, d).select("job", "idx", F.when(F.col("idx") % 4 == 1, F.lit("new words")).otherwise(F.col("translated")).alias("translated"), F.when(F.col("idx") % 5 == 2, "guest").otherwise(F.col("speaker")).alias("speaker"))
    return intake.reusable_takes(new, old)


def notes(s, d):
    c = table(s, d, "orders")
    rows = c.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("note"))
    return intake.appended_notes(rows.where("at % 3 != 0"), rows.where("at % 3 = 0"), most=5)


def event_merge(s, d):
    e = events(s, d).select("event_id", "event_type", "value")
    fresh = e.where("event_id % 3 = 0").withColumn("event_type", F.lit("fresh"))
    return intake.merged_events(e.where("event_id % 5 != 1"), fresh, "event_id")


def stage_keys(s, d):
    a = jobs(s, d).where("stage != 'tts'").groupBy("stage").agg(F.count(F.lit(1)).alias("recent"))
    b = jobs(s, d).where("stage != 'extract'").groupBy("stage").agg(F.count(F.lit(1)).alias("baseline"))
    return intake.either(a, b, "stage")


def ordered_keys(s, d):
    place = {"expired": 0, "expiring": 1, "active": 2, "idle": 3, "revoked": 4}
    rows = key_rows(s, d).select("key_id", F.when(F.col("revoked"), "revoked").when(F.col("expires").isNotNull(), "expired").otherwise("active").alias("state"))
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("state")), F.lit(9))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(F.col("key_id") % 16).orderBy(order, F.desc("key_id"))))


def profiles(s, d):
    rows = table(s, d, "customer").select("c_custkey", scalars.group_name(F.concat(F.lit(" "), "c_mktsegment")).alias("grp"), F.col("c_name").alias("name"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("grp").orderBy("name", "c_custkey")))


def findings(s, d):
    rows = events(s, d).select("user_id", F.when(F.col("event_type") == "error", "loss").when(F.col("event_type") == "click", "warn").otherwise("info").alias("severity"))
    return intake.findings(rows, "user_id")


def blocks(s, d):
    rows = table(s, d, "part").select(F.col("p_size").alias("grp"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("term"), F.col("p_brand").alias("mapped"))
    return intake.glossary_block(rows, "grp").select("grp", F.md5("block").alias("block"))


def times(s, d):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "2026-08-05T02:00").when(k % 4 == 2, "2026-08-05 02:00:00+03:00").otherwise("soon")
    return events(s, d).select("event_id", scalars.epoch_seconds(text).alias("at"))


def budgets(s, d):
    rows = events(s, d).select("event_id", (F.col("event_id") % 9000).alias("chars"), (F.col("event_id") % 40 + 1).alias("lines"))
    limits = scalars.batch_limits(F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 40_000), F.when(F.col("event_id") % 4 == 0, F.lit(30)).otherwise(F.lit(0)), F.lit(0))
    budget = scalars.output_budget(F.col("chars"), F.col("lines"))
    return rows.select("event_id", limits.alias("l"), budget.alias("budget"), scalars.batch_timeout(budget, F.lit(2), F.lit(0)).alias("timeout")).select("event_id", "l.lines", "l.chars", "budget", "timeout")


def starved(s, d):
    rows = jobs(s, d).select("batch_id", "id", (F.col("status") == "error").alias("starved"))
    return workbench.budget_multiplier(rows, "batch_id", "id")


def aligned(s, d):
    rows = segments(s, d).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "translated"))).alias("x"))
    rows = rows.select("job", F.col("x.text").alias("source"), F.slice(F.col("x.translated"), 1, 3).alias("target"))
    return intake.aligned(rows, "source", "target").select("job", "pos", F.md5("source").alias("source"), F.md5("target").alias("target"))


def stored(s, d):
    rows = segments(s, d).groupBy("job").agg(F.array_sort(F.collect_list("idx")).alias("transcript"), F.max("end_ms").alias("_source_info"))
    return intake.stored(rows, keep=4).select("job", F.array_join(F.transform("transcript", lambda x: x.cast("string")), ",").alias("transcript"), "transcript_truncated")


def compacted(s, d):
    rows = jobs(s, d).select("id", "status", "error", F.struct(F.col("stage").alias("video_id"), F.col("minutes").alias("duration"), "voice_mode").alias("meta"))
    return intake.compact(rows, ["id", "status", "meta"], ["video_id", "thumbnail"]).select("id", "status", F.to_json("meta").alias("meta"))


def stored_scan(s, d):
    """Jobs stored as JSON by status, and of them the failed and paused ones of the last ten days."""
    where = scratch.folder(s, "jobs")
    j = jobs(s, d)
    data = F.to_json(F.struct("status", F.unix_timestamp("created").cast("double").alias("created"), F.col("batch_id").cast("string").alias("batch_id"), "stage"))
    store.store_jobs(j.select(F.col("id").cast("string").alias("id"), data.alias("data")), where)
    found = store.stored_jobs(s, where, status=["error", "paused"], since=1705795200.0)
    return found.select(F.col("id").cast("long").alias("id"), "status", F.col("batch_id").cast("long").alias("batch_id"))


def log_tail(s, d):
    """The newest hundred entries of a log of JSON lines, read from the ends of its files."""
    where = scratch.folder(s, "lines")
    rows = events(s, d).repartitionByRange("event_id").sortWithinPartitions("event_id")
    rows.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(where)
    return tail.recent(s, where, "event_id long, event_type string, value double", limit=100).select("event_id", "event_type", "value")


QUERIES = {
    "stored_scan": stored_scan,
    "log_tail": log_tail,
    "failure_shape": lambda s, d: failed(s, d).select("event_id", scalars.failure_class(scalars.output_blob(F.col("stderr"), F.col("stdout")), scalars.FAILURE_SHAPES).alias("shape")),
    "download_failure": download_failures,
    "error_line": lambda s, d: failed(s, d).select("event_id", scalars.error_line(F.col("stderr"), F.col("stdout")).alias("line")),
    "challenge_403": lambda s, d: failed(s, d).select("event_id", scalars.is_forbidden(scalars.output_blob(F.col("stderr"), F.col("stdout"))).alias("forbidden"), scalars.needs_challenge_solver(scalars.output_blob(F.col("stderr"), F.col("stdout"))).alias("challenge")),
    "metadata_curated": curated,
    "publish_meta": published,
    "candidates": lambda s, d: intake.candidate(feed(s, d)),
    "candidate_details": candidate_details,
    "first_match": first_jobs,
    "gates_resolved": gates,
    "gates_refused": lambda s, d: intake.bad_gates(gate_jobs(s, d).withColumn("explicit", F.create_map(F.col("stage"), F.lit("on"), F.lit("subtitles"), F.lit("maybe")))),
    "gates_rearmed": lambda s, d: intake.rearmed(gate_jobs(s, d)).select("id", F.array_join("cleared", ",").alias("cleared")),
    "earlier_stage": lambda s, d: jobs(s, d).select("id", intake.earlier_stage(F.col("stage"), _pick(["", "diarize", "merge"], F.col("id"))).alias("stage")),
    "stage_quality": lambda s, d: intake.stage_quality(quality_rows(s, d)),
    "word_confidence": confidences,
    "benchmark_measure": lambda s, d: intake.measured(runs(s, d), language="ru"),
    "speech_rate_fallback": languages,
    "digit_counts": lambda s, d: table(s, d, "documents").select("doc_id", tx.digits(F.concat("text", F.lit(" ٤٠ 十八"))).cast("long").alias("digits"), tx.digits(F.concat("text", F.lit(" ٤٠ 十八")), "zh").cast("long").alias("numerals")),
    "language_names": lambda s, d: jobs(s, d).select("id", intake.language_name(F.when(F.col("id") % 6 == 0, "Qx-1").otherwise(F.concat("target_lang", F.lit("-XX")))).alias("name")),
    "translation_pairs": lambda s, d: jobs(s, d).select("id", scalars.is_pair(F.lit("es-419"), F.col("target_lang")).alias("pair")),
    "batch_plausible": lambda s, d: intake.plausible_batches(segments(s, d).withColumnRenamed("job", "batch")),
    "bug_report": reports,
    "webhook_payload": payloads,
    "public_keys": lambda s, d: intake.public_keys(key_rows(s, d)),
    "token_verify": tokens_verified,
    "delete_jobs": lambda s, d: intake.without_keys(jobs(s, d).select("id", "status"), events(s, d).where("event_type = 'click'").select(F.col("event_id").alias("id")), "id"),
    "stored_jobs": stored,
    "compact_jobs": compacted,
    "flags_shown": flags_shown,
    "synth_retry": synth_retry,
    "review_notes": notes,
    "event_merge": event_merge,
    "stage_union": stage_keys,
    "key_order": ordered_keys,
    "profile_order": profiles,
    "finding_counts": findings,
    "glossary_block": blocks,
    "when_parse": times,
    "batch_budget": budgets,
    "budget_tuner": starved,
    "guidance": lambda s, d: events(s, d).select("event_id", scalars.guidance(F.col("value"), F.when(F.col("event_id") % 4 == 0, F.lit(1.5)).when(F.col("event_id") % 4 == 1, F.lit(0.0)), 2.5, F.col("event_id") % 3 == 0).alias("cfg")),
    "aligned_lines": aligned,
    "qa_text": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(scalars.qa_text(F.col("text"))).alias("text")),
    "text_chunks": lambda s, d: tx.chunk_rows(table(s, d, "documents"), 80),
    "fallback_reference": lambda s, d: folds.fallback_reference(segments(s, d)),
    "source_labels": lambda s, d: jobs(s, d).select("id", scalars.source_label(F.when(F.col("id") % 4 == 0, F.lit(" ")), F.when(F.col("id") % 3 == 0, F.col("stage")), F.concat("status", F.lit(" -> "), F.col("target_lang")), F.col("id")).alias("label")),
    "safe_numbers": lambda s, d: events(s, d).select("event_id", scalars.safe_number(_pick(["1.5", "NaN", "x", "-Infinity", " 7 "], F.col("event_id"))).alias("n")),
    "masked": lambda s, d: table(s, d, "customer").select("c_custkey", scalars.mask(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(F.lit("abc"))).alias("masked")),
}

_SPEECH = "least(end_ms - start_ms, 15000)"
ORACLES = {
    "candidate_details": """SELECT user_id::VARCHAR AS video_id, CASE WHEN event_id % 7 != 0 THEN 'ch ' || user_id ELSE '' END AS channel, CASE WHEN event_id % 4 != 1 THEN event_id % 11 - 5 END AS rank_delta, event_id % 6 = 1 AS is_short, event_id AS rank FROM events""",
    "stored_scan": f"WITH {JOBS_SQL} SELECT id, status, batch_id FROM jobs WHERE status IN ('error', 'paused') AND created >= TIMESTAMP '2024-01-21'",
    "log_tail": "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 100",
    "qa_text": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM\\p{Pc}\\s\\x{0085}\\x{00A0}]', ' ', 'g'), '[\\s\\x{0085}\\x{00A0}]+', ' ', 'g'))) AS text FROM documents",
    "failure_shape": f"SELECT event_id, {_quoted(c for _, c, _ in OUTPUTS)}[event_id % {len(OUTPUTS)} + 1] AS shape FROM events",
    "download_failure": f"""WITH {_FAILED}, c AS (SELECT *, {_quoted(c for *_, c in OUTPUTS)}[event_id % {len(OUTPUTS)} + 1] AS failure_class, CASE WHEN source = '' THEN '<URL>' ELSE '''' || source || '''' END AS q FROM failed)
        SELECT event_id, failure_class, left(coalesce(errors[1], shown), 200) AS detail, CASE failure_class {_commands_sql()} END AS commands FROM c""",
    "error_line": f"""WITH {_FAILED} SELECT event_id, coalesce(left(errors[-1], 300), nullif(right(shown, 300), ''), nullif(stdout, ''), '{scalars.SILENT}') AS line FROM failed""",
    "challenge_403": f"""WITH {_FAILED}, l AS (SELECT event_id, lower(stderr || ' ' || stdout) AS b FROM failed)
        SELECT event_id, contains(b, 'http error 403') OR contains(b, '403') AND (contains(b, 'forbidden') OR contains(b, 'status code 403')) AS forbidden,
               {" OR ".join(f"contains(b, '{x}')" for x in scalars.CHALLENGE)} AS challenge FROM l""",
    "metadata_curated": """WITH i AS (SELECT *, string_split(text, ' ')[1:20] AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: {'start': i - 1, 'title': trim(x)}), lambda c: c.title != '') AS ch FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN source || ' Official Video' ELSE source END AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS channel, len(t)::INTEGER AS n_tags, md5(array_to_string(t, '|')) AS tags,
               md5(substr(text, 1, 10000)) AS description, len(ch)::INTEGER AS chapters, ch[-1].start::INTEGER AS last_start, doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0 AS is_music FROM i""",
    "publish_meta": """SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 AND trim(text) != '' THEN trim(text, ' ') WHEN doc_id % 4 != 0 THEN source ELSE doc_id::VARCHAR END) AS title,
        md5(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 2 = 1 THEN nullif(trim(text, ' '), '') END, 'Original: ' || CASE WHEN doc_id % 2 = 0 THEN 'http://a/b' WHEN doc_id % 5 = 0 THEN 'http://page' END)) AS description,
        CASE WHEN doc_id % 6 = 0 THEN array_to_string(string_split(text, ' ')[1:10], '|') ELSE lang END AS tags, true AS is_private FROM documents""",
    "candidates": """SELECT user_id::VARCHAR AS video_id, 'https://www.youtube.com/watch?v=' || user_id AS url, event_type AS title, CASE event_id % 3 WHEN 0 THEN 189 WHEN 1 THEN event_id END AS duration_sec,
        floor(value)::BIGINT AS view_count, event_id AS rank, CASE WHEN event_id % 4 = 0 THEN 10 END::BIGINT AS category_id, event_id % 4 = 0 AS is_music FROM events""",
    "first_match": f"""WITH {JOBS_SQL}, f AS (SELECT batch_id, min(id) AS matched FROM jobs WHERE status = 'complete' GROUP BY batch_id)
        SELECT event_id, user_id, matched, matched IS NOT NULL AS known FROM events LEFT JOIN f ON user_id = batch_id""",
    "gates_resolved": """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'flagged_only' ELSE 'off' END AS transcript, 'off' AS translation, CASE WHEN event_id % 4 = 1 THEN 'on' ELSE 'off' END AS voice_cast,
        CASE WHEN event_id % 3 = 0 THEN 'on' ELSE 'off' END AS subtitles, 'off' AS final_qc FROM events""",
    "gates_refused": """SELECT event_id AS id, ['transcribe', 'translate', 'tts', 'merge', 'unknown'][event_id % 5 + 1] AS gate, 'on' AS mode FROM events UNION ALL SELECT event_id, 'subtitles', 'maybe' FROM events""",
    "gates_rearmed": """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'transcript' WHEN 2 THEN 'transcript,translation' WHEN 3 THEN 'transcript,translation,subtitles' ELSE 'transcript,translation,subtitles,final_qc' END AS cleared FROM events""",
    "earlier_stage": f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 3 = 1 AND stage IN ('translate', 'tts', 'assemble') THEN 'diarize' ELSE stage END AS stage FROM jobs""",
    "stage_quality": f"""WITH {SEGMENTS_SQL} SELECT job, count(*) AS segments, round(avg(cer) FILTER (measured), 4) AS word_conf_mean, round(count(*) FILTER (no_speech > 0.5) / count(*), 4) AS no_speech_ratio,
        round(count(*) FILTER (trim(text) != '' AND trim(translated) IN ('', trim(text))) / count(*), 4) AS fallback_ratio, count(*) FILTER (tier = 2) AS missing_audio,
        round(count(*) FILTER (measured AND cer > 0.4) / nullif(count(*) FILTER (measured), 0), 4) AS failed_qa_ratio FROM segments GROUP BY job""",
    "word_confidence": """WITH w AS (SELECT conv_id AS job, turn AS idx, CASE WHEN turn % 3 != 2 THEN list_transform(list_filter(range(1, turn + 2), lambda i: i % 4 != 0), lambda i: (i * 7 % 16) / 16.0::DOUBLE) ELSE [] END AS p FROM conversations)
        SELECT job, idx, CASE WHEN len(p) > 0 THEN round(list_sum(p) / len(p), 4) END AS word_conf_mean, CASE WHEN len(p) > 0 THEN round(list_min(p), 4) END AS word_conf_min FROM w""",
    "benchmark_measure": f"""WITH {SEGMENTS_SQL}, {_RUNS}, l AS (SELECT *, length(regexp_replace(translated, '\\PL+', '', 'g')) AS letters, length(regexp_replace(translated, '[^\\x{{0400}}-\\x{{052F}}]+', '', 'g')) AS cyr,
            length(regexp_replace(text, '[^0-9]+', '', 'g')) AS a, length(regexp_replace(translated, '[^0-9]+', '', 'g')) AS b FROM runs)
        SELECT run, count(*) AS segments, count(*) FILTER (trim(text) = trim(translated)) AS fallback, count(*) FILTER (contains(translated, 'Here is the translation')) AS meta,
               count(*) FILTER (letters < 8 OR cyr >= letters * 0.3::DOUBLE) / count(*) AS script_ok, least(sum(b) / nullif(sum(a), 0), 1.0) AS digits_kept, avg(length(translated) / greatest(length(trim(text)), 1)) AS len_ratio FROM l GROUP BY run""",
    "speech_rate_fallback": """WITH o AS (SELECT lang, text, min((n_chars % 90) + 10)::DOUBLE AS seconds FROM documents WHERE lang != 'fr' GROUP BY lang, text), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, text) AS nth FROM o),
        m AS (SELECT lang AS code, median(length(text) / seconds) AS known FROM r WHERE nth <= 8 GROUP BY lang),
        n AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN lang || '-XX' ELSE ['ja', 'zh-CN', 'hi', 'xx', 'ko-KR', 'th'][doc_id // 2 % 6 + 1] END AS lang FROM documents),
        s(code, share) AS (VALUES ('ja', 0.42::DOUBLE), ('zh', 0.3::DOUBLE), ('hi', 0.85::DOUBLE), ('ko', 0.55::DOUBLE), ('th', 0.8::DOUBLE))
        SELECT lang, coalesce(known, 10.6::DOUBLE * coalesce(share, 1.0::DOUBLE)) AS rate, known IS NOT NULL AS measured FROM n LEFT JOIN m ON left(lang, 2) = m.code LEFT JOIN s ON left(lang, 2) = s.code""",
    "digit_counts": """WITH t AS (SELECT doc_id, text || ' ٤٠ 十八' AS t FROM documents) SELECT doc_id, length(regexp_replace(t, '[^\\p{Nd}]+', '', 'g')) AS digits,
        length(regexp_replace(t, '[^\\p{Nd}〇零一壹二貳贰三參叁四肆五伍六陸陆七柒八捌九玖十拾百佰千仟万萬億兆]+', '', 'g')) AS numerals FROM t""",
    "language_names": f"""WITH {JOBS_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 'Qx-1' ELSE CASE target_lang WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Japanese' END END AS name FROM jobs""",
    "translation_pairs": f"WITH {JOBS_SQL} SELECT id, target_lang != 'es' AS pair FROM jobs",
    "batch_plausible": f"""WITH {SEGMENTS_SQL} SELECT job AS batch, bool_and(length(trim(translated)) > 0 AND length(trim(translated)) <= greatest(80, length(text) * 5)) AS plausible FROM segments GROUP BY job""",
    "bug_report": f"""WITH {JOBS_SQL}, m AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'tts' ELSE stage END AS st, CASE WHEN id % 2 = 0 THEN error || ' token=abcdef' ELSE error END AS msg FROM jobs WHERE error IS NOT NULL)
        SELECT id, status, 'https://u?api_key=[redacted]' AS source, target_lang, st AS stage, replace(msg, 'token=abcdef', 'token=[redacted]') AS message,
               substr(sha256(st || '|' || regexp_replace(lower(msg), '\\b[0-9]+', '<n>', 'g')), 1, 12) AS signature FROM m""",
    "webhook_payload": f"""WITH {JOBS_SQL} SELECT id AS job_id, stage AS title, minutes::DOUBLE AS duration_sec, status, target_lang, batch_id FROM jobs""",
    "public_keys": "SELECT c_custkey AS key_id, c_name, c_custkey % 7 = 0 AS revoked, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2020-01-01' END AS expires, 'live' AS environment FROM customer",
    "token_verify": "SELECT 'gcd_' || s_suppkey AS token, CASE WHEN s_suppkey < 25 AND s_suppkey % 7 != 0 AND s_suppkey % 4 != 0 THEN s_suppkey END AS key_id FROM supplier",
    "delete_jobs": f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE status != 'paused'",
    "stored_jobs": f"WITH {SEGMENTS_SQL} SELECT job, array_to_string((list(idx ORDER BY idx))[1:4], ',') AS transcript, count(*) > 4 AS transcript_truncated FROM segments GROUP BY job",
    "compact_jobs": f"""WITH {JOBS_SQL} SELECT id, status, '{{"video_id":"' || stage || '"}}' AS meta FROM jobs""",
    "synth_retry": f"WITH {SEGMENTS_SQL} SELECT job, idx, idx % 4 != 1 AND idx % 5 != 2 AND tier != 3 AS reused FROM segments",
    "review_notes": """WITH r AS (SELECT o_custkey AS job, o_orderkey AS "at", o_orderstatus AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 3 = 0)::INTEGER DESC, o_orderkey DESC, o_orderstatus DESC) AS nth FROM orders)
        SELECT job, "at", note FROM r WHERE nth <= 5""",
    "event_merge": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fresh' ELSE event_type END AS event_type, value FROM events WHERE event_id % 5 != 1 OR event_id % 3 = 0",
    "stage_union": f"""WITH {JOBS_SQL} SELECT stage, nullif(count(*) FILTER (stage != 'tts'), 0) AS recent, nullif(count(*) FILTER (stage != 'extract'), 0) AS baseline FROM jobs GROUP BY stage""",
    "key_order": """WITH k AS (SELECT c_custkey AS key_id, CASE WHEN c_custkey % 7 = 0 THEN 'revoked' WHEN c_custkey % 4 = 0 THEN 'expired' ELSE 'active' END AS state FROM customer)
        SELECT *, row_number() OVER (PARTITION BY key_id % 16 ORDER BY CASE state WHEN 'expired' THEN 0 WHEN 'active' THEN 2 ELSE 4 END, key_id DESC) AS nth FROM k""",
    "profile_order": "SELECT c_custkey, lower(c_mktsegment) AS grp, c_name AS name, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_name, c_custkey) AS nth FROM customer",
    "finding_counts": """SELECT user_id, count(*) FILTER (event_type = 'error') AS loss, count(*) FILTER (event_type = 'click') AS warn, count(*) FILTER (event_type NOT IN ('error', 'click')) AS info,
        count(*) FILTER (event_type = 'error') = 0 AS ok FROM events GROUP BY user_id""",
    "glossary_block": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS nth FROM part)
        SELECT p_size AS grp, md5(chr(10) || 'Always use these translations for these terms:' || chr(10) || string_agg('  - ' || p_name || ' → ' || p_brand, chr(10) ORDER BY nth) || chr(10)) AS block FROM r WHERE nth <= 60 GROUP BY p_size""",
    "when_parse": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 1785895200.0::DOUBLE WHEN 2 THEN 1785884400.0::DOUBLE END AS \"at\" FROM events",
    "batch_budget": """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 40000 = 0 THEN 8192 ELSE event_id % 40000 END AS ctx, 4096 + floor((event_id % 9000) * 1.2::DOUBLE)::BIGINT + (event_id % 40 + 1) * 16 + 256 AS budget FROM events)
        SELECT event_id, (CASE WHEN event_id % 4 = 0 THEN 30 ELSE greatest(4, least(24, ctx // 512)) END)::INTEGER AS lines, greatest(80, greatest(800, least(6000, ctx // 4)))::INTEGER AS chars, budget, 300.0::DOUBLE * greatest(1.0, budget / 4096.0::DOUBLE) * 2 AS timeout FROM r""",
    "budget_tuner": f"""WITH {JOBS_SQL} SELECT batch_id, id, status = 'error' AS starved, least(power(4.0::DOUBLE, least(count(*) FILTER (status = 'error') OVER (PARTITION BY batch_id ORDER BY id ROWS UNBOUNDED PRECEDING), 30)), 16)::BIGINT AS multiplier FROM jobs""",
    "guidance": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1.5::DOUBLE WHEN event_id % 3 = 0 THEN greatest(value, 2.5::DOUBLE) ELSE value END AS cfg FROM events",
    "aligned_lines": f"""WITH {SEGMENTS_SQL}, r AS (SELECT job, text, translated, row_number() OVER (PARTITION BY job ORDER BY idx) - 1 AS pos FROM segments) SELECT job, pos::INTEGER AS pos, md5(text) AS source, md5(translated) AS target FROM r WHERE pos < 3""",
    "fallback_reference": f"""WITH {SEGMENTS_SQL}, p AS (SELECT job, start_ms, end_ms, end_ms - start_ms AS ms, CASE WHEN end_ms - start_ms BETWEEN 1500 AND 12000 THEN 0 WHEN end_ms - start_ms >= 500 THEN 1 END AS turn FROM segments WHERE trim(text) != ''),
        a AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY job ORDER BY ms DESC, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE turn = 0),
        x AS (SELECT job, start_ms, end_ms, ms FROM a WHERE before < 30000), t AS (SELECT job, sum(ms) AS total FROM x GROUP BY job),
        b AS (SELECT p.*, coalesce(total, 0) AS total, coalesce(total, 0) + coalesce(sum(ms) OVER (PARTITION BY p.job ORDER BY ms DESC, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p LEFT JOIN t ON p.job = t.job WHERE turn = 1)
        SELECT job, start_ms, end_ms FROM x UNION ALL SELECT job, start_ms, end_ms FROM b WHERE total < 6000 AND before < 30000""",
    "source_labels": f"WITH {JOBS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN stage ELSE status END AS label FROM jobs",
    "safe_numbers": "SELECT event_id, [1.5, 0, 0, 0, 7][event_id % 5 + 1]::DOUBLE AS n FROM events",
    "masked": "SELECT c_custkey, CASE WHEN c_custkey % 3 != 0 THEN 'Cust…' ELSE '…' END AS masked FROM customer",
}
