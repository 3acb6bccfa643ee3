"""Queries of timelines and quality over ``conversations``, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.functions import text as tx
from cuemill.operators import narration, quality, timeline
from cuemill.sources import files
from cuemill.sources.standin import SEGMENTS_SQL, segments


def placed(s, d):
    p = timeline.place(segments(s, d).select("job", "idx", "start_ms", "dub_ms", "end_ms"))
    return p.select("job", "idx", F.col("start_ms").alias("src_start"), F.col("end_ms").alias("src_end"), "dub_start", "dub_end")


def slides(s, d):
    """Each job's segments as a Markdown script: every third one begins a slide, every fifth one is a list item with a comment ahead."""
    idx, text = F.col("idx"), F.col("text")
    lines = F.when(idx % 3 == 1, F.concat(F.lit("## *"), "speaker", F.lit("* ##\n"), text, F.lit("\n<!-- pause: "), (idx % 50).cast("string"), F.lit(" -->")))
    lines = lines.when(idx % 5 == 0, F.concat(F.lit("<!-- un\nspoken -->\n\n- **"), text, F.lit("**"))).otherwise(text)
    x = segments(s, d).where(~F.contains("text", F.lit("\n"))).select("job", F.struct(idx, lines.alias("l")).alias("x"))
    whole = x.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda e: e["l"]), "\n").alias("text"))
    found = files.scripts(whole.withColumn("text", F.concat(F.lit("# Job\n"), "text")), key="job")
    return found.select("job", "position", "id", "title", "pause_after", F.size("paragraphs").alias("n"), F.md5(F.array_join("paragraphs", "|")).alias("said"))


def turns(s, d):
    """Speaker turns: the segments themselves, shifted and overlapping."""
    x = segments(s, d)
    return x.select("job", F.col("idx").alias("pos"), (F.col("start_ms") + 700).alias("t_start"), (F.col("end_ms") + 1900).alias("t_end"), F.col("speaker").alias("who"))


def totals(s, d):
    return segments(s, d).groupBy("job").agg((F.max("end_ms") + 4000).alias("total_ms"))


def speech(s, d):
    """All segments of a job that have a length, as what voice detection kept."""
    return segments(s, d).where("end_ms > start_ms").select("job", "start_ms", "end_ms")


def with_next(s, d):
    return timeline.next_start(segments(s, d).join(totals(s, d), "job"), "total_ms").select("job", "idx", "start_ms", "dub_ms", "next_start")


def cues(s, d):
    """Cues that overlap: each begins 400 ms early."""
    return segments(s, d).select("job", "idx", (F.col("start_ms") - 400).alias("start_ms"), (F.col("end_ms") + 100).alias("end_ms"))


def quality_parts(s, d):
    x = segments(s, d)
    return quality.asr_quality(x), quality.translation_quality(x), quality.tts_quality(x), quality.timing_quality(placed(s, d))


def artifacts(s, d):
    x = segments(s, d)
    return x.select(
        "job",
        "idx",
        F.element_at(F.array(F.lit("transcribe"), F.lit("translate"), F.lit("tts")), (F.col("idx") % 3 + 1).cast("int")).alias("stage"),
        "cer",
        F.when(F.col("tier") != 1, F.col("no_speech")).alias("no_speech_ratio"),
        F.col("cer").alias("word_conf"),
        (F.col("no_speech") / 10).alias("fallback_ratio"),
        (F.col("cer") / 4).alias("failed_ratio"),
    )


def speaker_rollup(s, d):
    w = Window.partitionBy("job")
    g = segments(s, d).groupBy("job", "speaker").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("talk_ms"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"share": F.col("talk_ms") / F.sum("talk_ms").over(w), "nth": F.row_number().over(w.orderBy(F.desc("talk_ms"), "speaker"))})


def context_lines(s, d):
    """Each segment with the two before it, as a translator sees them."""
    w = Window.partitionBy("job").orderBy("idx").rowsBetween(-2, -1)
    return segments(s, d).select("job", "idx", F.array_join(F.collect_list("text").over(w), " | ").alias("context"))


def edit_cost(s, d):
    """Seconds of the union of segments that edits touch: a speaker's and those with a name; each segment once."""
    x = segments(s, d).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    a = x.where("speaker = 'user'").select("job", "idx", "ms")
    b = x.where("idx % 3 = 0").select("job", "idx", "ms")
    return a.union(b).distinct().groupBy("job").agg(F.sum("ms").alias("touched_ms"), F.count(F.lit(1)).alias("segments"))


def repeat_keys(s, d):
    """Short lines (case and blanks folded) that occur more than once in a job: processed once, reused."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return segments(s, d).groupBy(key.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("job") * 1000 + F.col("idx")).alias("first")).where("n > 1")


def stage_report(s, d):
    """Stages of a job with stale ones: an earlier stage (by idx) finished later than this one."""
    x = segments(s, d).select("job", "idx", (F.col("start_ms") + F.col("dub_ms") * (F.col("tier") % 2) * 3).alias("done_ms"))
    w = Window.partitionBy("job").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return x.select("job", "idx", "done_ms", F.when(F.max("done_ms").over(w) > F.col("done_ms"), "stale").otherwise("done").alias("status"))


def partial_retry(s, d):
    """Which translations a retry may reuse: same idx and source text, translated before."""
    old = segments(s, d).select("job", "idx", F.col("text").alias("old_text"), F.col("translated").alias("old"))
    new = segments(s, d).select("job", "idx", F.when(F.col("idx") % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    rows = new.join(old, ["job", "idx"], "left")
    keep = (F.col("text") == F.col("old_text")) & ~quality.untranslated(F.col("text"), F.col("old"))
    return rows.groupBy("job").agg(F.count_if(keep).alias("reused"), F.count_if(~keep).alias("redone"))


def qc_checklist(s, d):
    """Per job: sync, translation and speaker checks as rows."""
    t = quality.timing_quality(placed(s, d)).select("job", F.lit("sync").alias("check"), F.when(F.col("max_stretch") > 1.05, "warn").otherwise("pass").alias("result"))
    r = quality.translation_quality(segments(s, d)).select("job", F.lit("translation").alias("check"), F.when(F.col("untranslated") > 0, "warn").otherwise("pass").alias("result"))
    v = segments(s, d).groupBy("job").agg(F.countDistinct("speaker").alias("k")).select("job", F.lit("voices").alias("check"), F.when(F.col("k") > 2, "warn").otherwise("pass").alias("result"))
    return t.unionByName(r).unionByName(v)


def srt(s, d):
    """One SRT text per job from its clamped cues."""
    from cuemill.sources.sinks import srt_text

    c = timeline.clamp_cues(cues(s, d)).join(segments(s, d).select("job", "idx", "text"), ["job", "idx"])
    return srt_text(c)


def thousandths(df, *names):
    """Percentiles to three places: engines interpolate with different last bits."""
    return df.withColumns({n: F.floor(F.col(n) * 1000 + 0.500001) / 1000.0 for n in names})


def loudnesses(s, d):
    """Loudness in LUFS of four jobs in five."""
    k = F.col("job")
    return segments(s, d).select("job").distinct().where(k % 5 != 0).select("job", ((k % 13) / F.lit(2.0) - 19.0).alias("lufs"))


def full_report(s, d):
    return quality.scores(*quality_parts(s, d), loudness=loudnesses(s, d))


def asr_words(s, d):
    """Segments with the confidence of their words, for two jobs in three."""
    k = F.col("job")
    least = F.when((k % 3 != 0) & (F.col("idx") % 4 != 1), F.col("tier") / F.lit(8.0))
    return quality.word_confidences(segments(s, d).withColumns({"word_conf_mean": least + 0.25, "word_conf_min": least}))


def bench_bleed(s, d):
    return quality.bleed_share(segments(s, d).withColumnRenamed("job", "run"), target="de", source="fr")


def replies(s, d):
    """Segments as a model's replies, with what models add in one of eight ways."""
    text, k = F.col("text"), F.col("idx") % 8
    ways = [("", ""), ("<think>a\nb</think>\n", ""), (" translation: ", ""), ("Text: x\n", " /no_think"), ("```", "```"), ('"', '"'), ("„", "“"), ("«", '"')]
    reply = F.lit(None).cast("string")
    for n, (front, back) in enumerate(ways):
        reply = F.when(k == n, F.concat(F.lit(front), text, F.lit(back))).otherwise(reply)
    return segments(s, d).select("job", "idx", reply.alias("reply"))


def bled(s, d):
    """Jobs with letters of another alphabet in every fifth line, and with words of the source in others."""
    marked = F.when(F.col("idx") % 5 == 0, F.concat("translated", F.lit(" Їжі"))).otherwise(F.col("translated"))
    found = quality.bleed_quality(segments(s, d).withColumn("translated", marked), target="ru", source="uk")
    other = quality.bleed_quality(segments(s, d), target="de", source="fr")
    text = lambda c, glue: F.coalesce(F.array_join(c, glue), F.lit("")).alias(c)
    columns = ["job", "bleed_count", text("bleed_indices", ","), text("bleed_examples", "; ")]
    return found.select(F.lit("ru").alias("target"), *columns).unionByName(other.select(F.lit("de").alias("target"), *columns))


QUERIES = {
    "translation_bleed": bled,
    "quality_report": full_report,
    "asr_words": asr_words,
    "benchmark_bleed": bench_bleed,
    "reply_cleaned": lambda s, d: replies(s, d).select("job", "idx", F.md5(tx.clean_reply(F.col("reply"))).alias("reply")),
    "narration_cues": lambda s, d: narration.narration_cues(segments(s, d)),
    "script_slides": slides,
    "overlap_speaker": lambda s, d: timeline.overlap_speaker(segments(s, d), turns(s, d)),
    "interval_coalesce": lambda s, d: timeline.coalesce_intervals(segments(s, d).where("end_ms - start_ms > 500").select("job", "start_ms", "end_ms"), pad=200),
    "longest_gap": lambda s, d: timeline.longest_gap(segments(s, d).where("end_ms > start_ms").select("job", "start_ms", "end_ms"), totals(s, d)),
    "vad_remap": lambda s, d: timeline.remap(segments(s, d).select("job", F.col("idx").alias("key"), F.floor(F.col("start_ms") / 2).alias("t")), speech(s, d)),
    "next_start": lambda s, d: with_next(s, d),
    "predicted_drift": lambda s, d: timeline.place(segments(s, d).select("job", "idx", "start_ms", "dub_ms")).select("job", "idx", "dub_start", "dub_end", (F.col("dub_start") - F.col("start_ms")).alias("drift_ms")),
    "segment_fit": lambda s, d: timeline.fit(with_next(s, d)),
    "cues": lambda s, d: timeline.clamp_cues(cues(s, d)),
    "cue_metrics": lambda s, d: timeline.cue_metrics(segments(s, d)),
    "cue_violations": lambda s, d: timeline.cue_violations(timeline.cue_metrics(segments(s, d)), cps=14.0, gap=301),
    "srt": srt,
    "narration_timeline": lambda s, d: timeline.narration(segments(s, d).select("job", F.floor(F.col("idx") / 3).alias("slide"), "idx", F.col("dub_ms").alias("length_ms"))),
    "line_batches": lambda s, d: timeline.line_batches(segments(s, d).select("job", "idx", F.length("text").alias("chars"))),
    "split_long": lambda s, d: timeline.split_long(segments(s, d)).select("job", "idx", "part", "start_ms", "end_ms", F.length("text").alias("chars")),
    "clip_selection": lambda s, d: timeline.take_longest(segments(s, d).select("job", "speaker", "idx", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"))),
    "asr_quality": lambda s, d: thousandths(quality.asr_quality(segments(s, d)), "p10_logprob"),
    "asr_worst": lambda s, d: quality.worst(segments(s, d), "logprob", descending=False),
    "translation_quality": lambda s, d: thousandths(quality.translation_quality(segments(s, d)), "ratio_p90"),
    "tts_quality": lambda s, d: thousandths(quality.tts_quality(segments(s, d)), "p90_cer"),
    "tts_tiers": lambda s, d: quality.tier_histogram(segments(s, d)),
    "timing_quality": lambda s, d: quality.timing_quality(placed(s, d)),
    "quality_rollup": lambda s, d: quality.scores(*quality_parts(s, d)),
    "verdicts": lambda s, d: quality.verdicts(*quality_parts(s, d)),
    "quality_gate": lambda s, d: quality.gates(quality.scores(*quality_parts(s, d)), quality.translation_quality(segments(s, d))),
    "reuse_gate": lambda s, d: quality.reuse_gate(artifacts(s, d)).select("job", "idx", "stage", "ok", "why"),
    "reuse_stats": lambda s, d: artifacts(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("hits"), F.max("job").alias("latest")),
    "speaker_rollup": speaker_rollup,
    "context_lines": context_lines,
    "edit_cost": edit_cost,
    "repeat_lines": repeat_keys,
    "stage_report": stage_report,
    "partial_retry": partial_retry,
    "qc_checklist": qc_checklist,
}

_PLACE = """placed AS (WITH b AS (SELECT *, coalesce(sum(dub_ms + 80) OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM segments)
    SELECT job, idx, start_ms, end_ms, dub_ms, (max(start_ms - before) OVER (PARTITION BY job ORDER BY idx) + before)::BIGINT AS dub_start,
           (max(start_ms - before) OVER (PARTITION BY job ORDER BY idx) + before + dub_ms)::BIGINT AS dub_end FROM b)"""
_NEXT = """totals AS (SELECT job, max(end_ms) + 4000 AS total_ms FROM segments GROUP BY job),
    nexts AS (SELECT job, idx, start_ms, dub_ms, coalesce(lead(start_ms) OVER (PARTITION BY job ORDER BY idx), total_ms) AS next_start FROM segments JOIN totals USING (job)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth FROM nexts)"""
_ASR = """asr AS (SELECT job, count(*) AS n_segments, count(logprob) AS n_scored, avg(logprob) AS mean_logprob, quantile_cont(logprob, 0.1) AS p10_logprob,
    count(*) FILTER (no_speech > 0.6) AS high_no_speech FROM segments GROUP BY job)"""
_TR = """kept AS (SELECT *, length(trim(translated)) = 0 OR trim(translated) = trim(text) AS none FROM segments WHERE length(trim(text)) > 0),
    ratios AS (SELECT *, CASE WHEN NOT none THEN length(trim(translated)) / length(trim(text)) END AS ratio FROM kept),
    translation AS (SELECT job, count(*) AS n_segments, count(*) FILTER (none) AS untranslated, count(*) FILTER (ratio > 2.0 OR ratio < 0.3) AS outliers,
    quantile_cont(ratio, 0.9) AS ratio_p90 FROM ratios GROUP BY job)"""
_TTS = """tts AS (SELECT job, n_with_qa, n_measured, mean_cer, p90_cer, degraded, n_measured / n_with_qa * 100.0::DOUBLE AS measured_pct,
    CASE WHEN n_measured > 0 THEN matched / n_measured END AS lang_match_rate FROM (
    SELECT job, count(*) AS n_with_qa, count(*) FILTER (measured) AS n_measured, avg(cer) FILTER (measured) AS mean_cer, quantile_cont(cer, 0.9) FILTER (measured) AS p90_cer,
           count(*) FILTER (tier = 0) AS degraded, count(*) FILTER (measured AND lang_match) AS matched FROM segments GROUP BY job))"""
_TIMING = _PLACE + """, timing AS (SELECT *, stretched / n_placed * 100.0::DOUBLE AS stretched_pct FROM (
    SELECT job, count(*) AS n_placed, count(*) FILTER (stretch > 1.05) AS stretched, max(stretch) AS max_stretch, avg(drift) AS mean_drift_ms
    FROM (SELECT *, (dub_end - dub_start) / (end_ms - start_ms) AS stretch, abs(dub_start - start_ms) AS drift FROM placed WHERE end_ms > start_ms) GROUP BY job))"""
_ALL = f"{SEGMENTS_SQL}, {_ASR}, {_TR}, {_TTS}, {_TIMING}"
_CLAMP = "least(100.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
_SCORES = f"""scores AS (SELECT *, CASE WHEN w > 0 THEN m / w END AS overall FROM (SELECT *,
    (CASE WHEN asr IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE + CASE WHEN translation IS NULL THEN 0.0 ELSE 0.25 END::DOUBLE + CASE WHEN tts IS NULL THEN 0.0 ELSE 0.3 END::DOUBLE + CASE WHEN timing IS NULL THEN 0.0 ELSE 0.15 END::DOUBLE) AS w,
    (coalesce(asr, 0) * 0.2::DOUBLE + coalesce(translation, 0) * 0.25::DOUBLE + coalesce(tts, 0) * 0.3::DOUBLE + coalesce(timing, 0) * 0.15::DOUBLE) AS m FROM (
    SELECT job, {_CLAMP.format(_CLAMP.format("(mean_logprob + 1.2::DOUBLE) / 1.0::DOUBLE * 100.0::DOUBLE") + " - least(20.0::DOUBLE, high_no_speech * 2.0::DOUBLE)")} AS asr FROM asr) a
    FULL JOIN (SELECT job, {_CLAMP.format("100.0::DOUBLE - untranslated / greatest(n_segments, 1) * 100.0::DOUBLE * 1.5::DOUBLE - outliers / greatest(n_segments, 1) * 100.0::DOUBLE * 0.5::DOUBLE")} AS translation FROM translation) r USING (job)
    FULL JOIN (SELECT job, CASE WHEN measured_pct > 0 THEN {_CLAMP.format("(coalesce(least(70.0::DOUBLE, greatest(0.0::DOUBLE, (1.0::DOUBLE - mean_cer / 0.8::DOUBLE) * 70.0::DOUBLE)), 70.0) + measured_pct / 100.0::DOUBLE * 30.0::DOUBLE) * coalesce(lang_match_rate, 1.0)")} END AS tts FROM tts) t USING (job)
    FULL JOIN (SELECT job, {_CLAMP.format("100.0::DOUBLE - stretched_pct * 0.5::DOUBLE - greatest(0.0::DOUBLE, max_stretch - 1.15::DOUBLE) * 200.0::DOUBLE")} AS timing FROM timing) m USING (job)))"""
_ARTIFACTS = """artifacts AS (SELECT job, idx, ['transcribe', 'translate', 'tts'][idx % 3 + 1] AS stage, CASE WHEN tier != 1 THEN no_speech END AS no_speech_ratio, cer AS word_conf,
    no_speech / 10 AS fallback_ratio, cer / 4 AS failed_ratio FROM segments)"""

ORACLES = {
    "quality_report": f"""WITH {_ALL}, {_SCORES}, l AS (SELECT DISTINCT job, (job % 13) / 2.0::DOUBLE - 19.0::DOUBLE AS lufs FROM segments WHERE job % 5 != 0),
        f AS (SELECT job, asr, translation, tts, timing, m, w, {_CLAMP.format("100.0::DOUBLE - greatest(0.0::DOUBLE, abs(lufs + 16.0::DOUBLE) - 2.0::DOUBLE) * 10.0::DOUBLE")} AS loud, lufs IS NOT NULL AS known FROM scores LEFT JOIN l USING (job))
        SELECT job, asr, translation, tts, timing, CASE WHEN known THEN loud END AS loudness,
               CASE WHEN known THEN (m + loud * 0.1::DOUBLE) / (w + 0.1::DOUBLE) WHEN w > 0 THEN m / w END AS overall FROM f""",
    "asr_words": f"""WITH {SEGMENTS_SQL}, w AS (SELECT job, CASE WHEN job % 3 != 0 AND idx % 4 != 1 THEN tier / 8.0::DOUBLE END AS least FROM segments)
        SELECT job, round(avg(least + 0.25::DOUBLE), 4) AS word_conf_mean, round(min(least), 4) AS word_conf_min FROM w GROUP BY job""",
    "benchmark_bleed": f"""WITH {SEGMENTS_SQL}, w AS (SELECT job AS run, idx, len(list_filter(list_intersect(list_distinct(regexp_extract_all(lower(translated), '[\\pL\\pN_]{{5,}}')),
              list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{{5,}}'))), lambda x: NOT regexp_matches(x, '[0-9]'))) > 0 AS hit FROM segments),
        n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY NOT hit, idx) AS nth FROM w)
        SELECT run, count(*) FILTER (hit) AS bleed_count, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (hit AND nth <= 10), '') AS bleed_indices, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 1) AS bleed_pct FROM n GROUP BY run""",
    "split_long": f"""WITH {SEGMENTS_SQL}, l AS (SELECT *, length(text) AS n, regexp_extract_all(text, '(?s).*?[.!?]\\s') AS pieces FROM segments),
        e AS (SELECT job, idx, n, unnest(generate_series(1, len(pieces))) AS k, pieces FROM l WHERE end_ms - start_ms > 15000 AND n >= 40),
        p AS (SELECT job, idx, n, sum(length(pieces[k])) OVER (PARTITION BY job, idx ORDER BY k)::BIGINT AS at_ FROM e),
        c AS (SELECT job, idx, arg_min(at_, abs(at_ * 2 - n) * 100000 + at_) AS cut FROM p WHERE at_ > 20 AND at_ < n - 20 GROUP BY job, idx),
        t AS (SELECT l.*, cut, (start_ms + floor((end_ms - start_ms) * cut / n))::BIGINT AS middle FROM l LEFT JOIN c USING (job, idx))
        SELECT job, idx, 0 AS part, start_ms, coalesce(middle, end_ms) AS end_ms, length(CASE WHEN cut IS NULL THEN text ELSE trim(left(text, cut), ' ') END)::INTEGER AS chars FROM t
        UNION ALL SELECT job, idx, 1, middle, end_ms, length(trim(substr(text, cut + 1), ' '))::INTEGER FROM t WHERE cut IS NOT NULL""",
    "translation_bleed": f"""WITH {SEGMENTS_SQL}, k AS (SELECT *, trim(translated) != '' AND trim(translated) != trim(text) AS whole, list_sort(list_filter(list_intersect(list_distinct(regexp_extract_all(lower(translated), '[\\pL\\pN_]{{5,}}')),
              list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{{5,}}'))), lambda x: NOT regexp_matches(x, '[0-9]'))) AS w FROM segments WHERE trim(text) != ''),
        p(target, source) AS (VALUES ('ru', 'uk'), ('de', 'fr')),
        r AS (SELECT target, job, idx, CASE WHEN target = 'ru' AND idx % 5 = 0 THEN 'non-ru letters ''ії''' WHEN whole AND len(w) > 0 THEN 'verbatim ' || source || ' word(s) [''' || array_to_string(w[1:3], ''', ''') || ''']' END AS why FROM k, p),
        n AS (SELECT *, row_number() OVER (PARTITION BY target, job ORDER BY why IS NULL, idx) AS nth FROM r)
        SELECT target, job, count(why) AS bleed_count, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx) FILTER (why IS NOT NULL AND nth <= 20), '') AS bleed_indices,
               coalesce(string_agg(why, '; ' ORDER BY idx) FILTER (why IS NOT NULL AND nth <= 5), '') AS bleed_examples FROM n GROUP BY target, job""",
    # What was added is gone; quotation marks that don't match, or that a text has of its own too, stay.
    "reply_cleaned": f"""WITH {SEGMENTS_SQL} SELECT job, idx, md5(CASE WHEN idx % 8 = 7 THEN '«' || text || '"' WHEN idx % 8 = 5 AND contains(text, '"') THEN '"' || text || '"' ELSE trim(text) END) AS reply FROM segments""",
    "narration_cues": f"""WITH RECURSIVE {SEGMENTS_SQL}, f AS (SELECT job, idx, start_ms, greatest(end_ms - start_ms, 0) AS span, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments),
        p AS (SELECT job, idx, start_ms, span, 0::BIGINT AS pos, text FROM f WHERE text != ''
              UNION ALL SELECT job, idx, start_ms, span, pos + h.pos, h.text FROM (
                  SELECT * EXCLUDE text, unnest([{{'pos': 0, 'text': left(text, cut)}}, {{'pos': cut + 1, 'text': substr(text, cut + 2)}}]) AS h FROM (
                      SELECT *, CASE WHEN l >= 0 AND (r = 0 OR m - l <= r - 1) THEN l WHEN r > 0 THEN m + r - 1 END AS cut FROM (
                          SELECT *, length(regexp_replace(left(text, m + 1), '[^ ]*$', '')) - 1 AS l, instr(substr(text, m + 1), ' ') AS r FROM (
                              SELECT *, length(text) // 2 AS m FROM p WHERE NOT regexp_matches(text, '^.{{0,42}}( .{{1,42}})?$')))) WHERE cut IS NOT NULL)),
        c AS (SELECT *, sum(length(text)) OVER (PARTITION BY job, idx) AS total, sum(length(text)) OVER (PARTITION BY job, idx ORDER BY pos) AS upto FROM p
              WHERE regexp_matches(text, '^.{{0,42}}( .{{1,42}})?$') OR NOT contains(text, ' ')),
        t AS (SELECT job, idx, pos, text, (start_ms + (2 * span * (upto - length(text)) + total) // (2 * total))::BIGINT AS start_ms, (start_ms + (2 * span * upto + total) // (2 * total))::BIGINT AS end_ms FROM c),
        n AS (SELECT *, (row_number() OVER (PARTITION BY job ORDER BY idx, pos) - 1)::INTEGER AS cue, lead(start_ms) OVER (PARTITION BY job ORDER BY idx, pos) AS nxt FROM t)
        SELECT job, cue, idx, start_ms, CASE WHEN nxt - end_ms < 121 AND nxt - 121 - start_ms >= 300 THEN nxt - 121 ELSE end_ms END AS end_ms, text FROM n""",
    "script_slides": f"""WITH {SEGMENTS_SQL}, x AS (SELECT job, idx, speaker, text, idx % 3 = 1 AS opens, idx % 3 != 1 AND idx % 5 = 0 AS apart FROM segments WHERE NOT contains(text, chr(10))),
        n AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY job ORDER BY idx) AS nth, count(*) FILTER (opens OR apart) OVER (PARTITION BY job ORDER BY idx) AS para FROM x),
        p AS (SELECT job, nth, para, string_agg(text, ' ' ORDER BY idx) AS said, max(speaker) FILTER (opens) AS title, max(least(idx % 50, 30)) FILTER (opens) AS pause FROM n GROUP BY job, nth, para),
        s AS (SELECT job, nth, max(title) AS title, max(pause)::DOUBLE AS pause_after, count(*)::INTEGER AS n, md5(string_agg(said, '|' ORDER BY para)) AS said FROM p GROUP BY job, nth),
        t AS (SELECT *, coalesce(title, 'Job') AS shown, (row_number() OVER (PARTITION BY job ORDER BY nth) - 1)::INTEGER AS position FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY job, lower(shown) ORDER BY nth) AS again FROM t)
        SELECT job, position, lower(shown) || CASE WHEN again > 1 THEN '-' || again ELSE '' END AS id, shown AS title, pause_after, n, said FROM u""",
    "overlap_speaker": f"""WITH {SEGMENTS_SQL}, h AS (SELECT a.job, a.idx, b.speaker AS who, least(a.end_ms, b.end_ms + 1900) - greatest(a.start_ms, b.start_ms + 700) AS overlap_ms, b.idx AS pos
            FROM segments a JOIN segments b ON a.job = b.job AND a.start_ms < b.end_ms + 1900 AND a.end_ms > b.start_ms + 700),
        r AS (SELECT *, row_number() OVER (PARTITION BY job, idx ORDER BY overlap_ms DESC, pos) AS nth FROM h)
        SELECT s.job, s.idx, coalesce(r.who, 'SPEAKER_00') AS who, coalesce(overlap_ms, 0) AS overlap_ms FROM segments s LEFT JOIN r ON s.job = r.job AND s.idx = r.idx AND nth = 1""",
    "interval_coalesce": f"""WITH {SEGMENTS_SQL}, p AS (SELECT job, greatest(start_ms - 200, 0) AS s, end_ms + 200 AS e FROM segments WHERE end_ms - start_ms > 500),
        b AS (SELECT *, max(e) OVER (PARTITION BY job ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
        i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT job, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY job, island""",
    "longest_gap": f"""WITH {SEGMENTS_SQL}, t AS (SELECT job, max(end_ms) + 4000 AS total_ms FROM segments GROUP BY job), p AS (SELECT * FROM segments WHERE end_ms > start_ms),
        c AS (SELECT job, start_ms, coalesce(max(end_ms) OVER (PARTITION BY job ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM p WHERE end_ms > start_ms),
        g AS (SELECT job, cursor AS from_ms, start_ms - cursor AS gap FROM c UNION ALL SELECT job, last_ms, total_ms - last_ms FROM (SELECT job, max(end_ms) AS last_ms FROM p GROUP BY job) JOIN t USING (job)),
        r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY gap DESC, from_ms) AS nth FROM g WHERE gap >= 3000)
        SELECT job, from_ms + 500 AS from_ms, gap - 1000 AS length_ms FROM r WHERE nth = 1""",
    "vad_remap": f"""WITH {SEGMENTS_SQL}, s AS (SELECT job, start_ms, end_ms, sum(end_ms - start_ms) OVER (PARTITION BY job ORDER BY start_ms) AS cum FROM segments WHERE end_ms > start_ms),
        q AS (SELECT job, idx AS key, floor(start_ms / 2)::BIGINT AS t FROM segments),
        h AS (SELECT q.job, key, t, end_ms - (cum - t) AS o, row_number() OVER (PARTITION BY q.job, key ORDER BY cum) AS nth FROM q JOIN s ON q.job = s.job AND t <= cum),
        l AS (SELECT job, max(end_ms) AS last_ms FROM s GROUP BY job)
        SELECT q.job, q.key, q.t, coalesce(o, last_ms, q.t)::BIGINT AS original_ms FROM q LEFT JOIN h ON q.job = h.job AND q.key = h.key AND nth = 1 LEFT JOIN l ON q.job = l.job""",
    "next_start": f"WITH {SEGMENTS_SQL}, {_NEXT} SELECT * FROM nexts",
    "predicted_drift": f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth FROM segments),
        f AS (SELECT job, idx, nth, start_ms AS dub_start, start_ms + dub_ms AS dub_end, start_ms FROM n WHERE nth = 1
              UNION ALL SELECT n.job, n.idx, n.nth, greatest(n.start_ms, f.dub_end + 80), greatest(n.start_ms, f.dub_end + 80) + n.dub_ms, n.start_ms FROM f JOIN n ON n.job = f.job AND n.nth = f.nth + 1)
        SELECT job, idx, dub_start, dub_end, dub_start - start_ms AS drift_ms FROM f""",
    "segment_fit": f"""WITH RECURSIVE {SEGMENTS_SQL}, {_NEXT}, z AS (SELECT job, idx, nth, start_ms AS placed, next_start - 80 - start_ms AS room, dub_ms FROM numbered WHERE nth = 1),
        f AS (SELECT job, idx, nth, placed, CASE WHEN room <= 200 OR dub_ms * 100 <= room * 102 THEN 1000 ELSE least(dub_ms * 1000 // greatest(room, 1), 1400) END AS speed, dub_ms FROM z
              UNION ALL SELECT job, idx, nth, placed, CASE WHEN room <= 200 OR dub_ms * 100 <= room * 102 THEN 1000 ELSE least(dub_ms * 1000 // greatest(room, 1), 1400) END, dub_ms FROM (
                  SELECT n.job, n.idx, n.nth, p.placed, n.next_start - 80 - p.placed AS room, n.dub_ms FROM f JOIN numbered n ON n.job = f.job AND n.nth = f.nth + 1,
                  LATERAL (SELECT CASE WHEN f.placed + f.dub_ms * 1000 // f.speed > 0 THEN greatest(n.start_ms, f.placed + f.dub_ms * 1000 // f.speed + 80) ELSE n.start_ms END AS placed) p))
        SELECT job, idx, placed, speed::BIGINT AS speed FROM f""",
    "cues": f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT job, idx, start_ms - 400 AS s, end_ms + 100 AS e, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth FROM segments),
        f AS (SELECT job, idx, nth, greatest(s, 0) AS start_ms, greatest(e, greatest(s, 0) + 500) AS end_ms FROM n WHERE nth = 1
              UNION ALL SELECT n.job, n.idx, n.nth, greatest(n.s, f.end_ms, 0), greatest(n.e, greatest(n.s, f.end_ms, 0) + 500) FROM f JOIN n ON n.job = f.job AND n.nth = f.nth + 1)
        SELECT job, idx, start_ms, end_ms FROM f""",
    "cue_metrics": f"""WITH {SEGMENTS_SQL} SELECT job, idx, start_ms, end_ms, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS chars_per_line,
        CASE WHEN end_ms > start_ms THEN length(replace(text, chr(10), '')) * 1000 / (end_ms - start_ms) END AS cps, lead(start_ms) OVER (PARTITION BY job ORDER BY idx) - end_ms AS gap_ms FROM segments""",
    "cue_violations": f"""WITH {SEGMENTS_SQL}, m AS (SELECT job, idx, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS chars_per_line,
        CASE WHEN end_ms > start_ms THEN length(replace(text, chr(10), '')) * 1000 / (end_ms - start_ms) END AS cps, lead(start_ms) OVER (PARTITION BY job ORDER BY idx) - end_ms AS gap_ms FROM segments)
        SELECT job, idx, 'line_too_long' AS kind, chars_per_line::DOUBLE AS value FROM m WHERE chars_per_line > 42 UNION ALL SELECT job, idx, 'too_many_lines', lines FROM m WHERE lines > 2
        UNION ALL SELECT job, idx, 'cps_exceeded', cps FROM m WHERE cps > 14.0 UNION ALL SELECT job, idx, 'gap_too_small', gap_ms FROM m WHERE gap_ms < 301""",
    "narration_timeline": f"""WITH {SEGMENTS_SQL}, u AS (SELECT job, idx // 3 AS slide, idx, dub_ms AS length_ms, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth, row_number() OVER (PARTITION BY job, idx // 3 ORDER BY idx) AS k FROM segments),
        w AS (SELECT *, CASE WHEN nth = 1 THEN 800 WHEN k = 1 THEN 1100 ELSE 250 END AS wait FROM u)
        SELECT job, slide, idx, (sum(wait + length_ms) OVER (PARTITION BY job ORDER BY slide, idx))::BIGINT - length_ms AS start_ms, (sum(wait + length_ms) OVER (PARTITION BY job ORDER BY slide, idx))::BIGINT AS end_ms FROM w""",
    "line_batches": f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT job, idx, length(text) AS chars, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth FROM segments),
        f AS (SELECT job, idx, nth, 0::BIGINT AS batch, 1::BIGINT AS k, chars AS c FROM n WHERE nth = 1
              UNION ALL SELECT n.job, n.idx, n.nth, CASE WHEN f.k >= 8 OR f.c + n.chars > 800 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.k >= 8 OR f.c + n.chars > 800 THEN 1 ELSE f.k + 1 END,
                     CASE WHEN f.k >= 8 OR f.c + n.chars > 800 THEN n.chars ELSE f.c + n.chars END FROM f JOIN n ON n.job = f.job AND n.nth = f.nth + 1)
        SELECT job, idx, batch FROM f""",
    "clip_selection": f"""WITH {SEGMENTS_SQL}, c AS (SELECT job, speaker, idx, end_ms - start_ms AS length_ms FROM segments),
        b AS (SELECT *, coalesce(sum(least(length_ms, 15000)) OVER (PARTITION BY job, speaker ORDER BY length_ms DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT job, speaker, idx, least(length_ms, 15000, 60000 - before)::BIGINT AS taken_ms FROM b WHERE least(length_ms, 15000, 60000 - before) >= 1000""",
    "asr_quality": f"WITH {SEGMENTS_SQL}, {_ASR} SELECT * REPLACE (floor(p10_logprob * 1000 + 0.500001) / 1000.0::DOUBLE AS p10_logprob) FROM asr",
    "asr_worst": f"WITH {SEGMENTS_SQL} SELECT job, nth, idx FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY logprob, idx) AS nth FROM segments) WHERE nth <= 5",
    "translation_quality": f"WITH {SEGMENTS_SQL}, {_TR} SELECT * REPLACE (floor(ratio_p90 * 1000 + 0.500001) / 1000.0::DOUBLE AS ratio_p90) FROM translation",
    "tts_quality": f"WITH {SEGMENTS_SQL}, {_TTS} SELECT * REPLACE (floor(p90_cer * 1000 + 0.500001) / 1000.0::DOUBLE AS p90_cer) FROM tts",
    "tts_tiers": f"WITH {SEGMENTS_SQL} SELECT job, tier, count(*) AS n FROM segments GROUP BY job, tier",
    "timing_quality": f"WITH {SEGMENTS_SQL}, {_TIMING} SELECT * FROM timing",
    "quality_rollup": f"WITH {_ALL}, {_SCORES} SELECT job, asr, translation, tts, timing, overall FROM scores",
    "verdicts": f"""WITH {_ALL} SELECT job, 'asr' AS stage, 'low confidence' AS kind, 'warn' AS severity, n_scored AS n FROM asr WHERE mean_logprob < -1.0
        UNION ALL SELECT job, 'asr', 'no speech', CASE WHEN high_no_speech > greatest(2, n_scored // 20) THEN 'warn' ELSE 'info' END, high_no_speech FROM asr WHERE high_no_speech > 0
        UNION ALL SELECT job, 'translation', 'untranslated', CASE WHEN untranslated * 100 >= n_segments * 10 THEN 'serious' ELSE 'warn' END, untranslated FROM translation WHERE untranslated > 0
        UNION ALL SELECT job, 'translation', 'outliers', 'warn', outliers FROM translation WHERE outliers > 0
        UNION ALL SELECT job, 'tts', 'degraded', CASE WHEN degraded * 100 >= n_with_qa * 10 THEN 'serious' ELSE 'warn' END, degraded FROM tts WHERE degraded > 0
        UNION ALL SELECT job, 'tts', 'language', 'warn', n_measured FROM tts WHERE lang_match_rate < 0.9
        UNION ALL SELECT job, 'tts', 'error rate', 'warn', n_measured FROM tts WHERE p90_cer > 0.4
        UNION ALL SELECT job, 'tts', 'coverage', 'info', n_measured FROM tts WHERE measured_pct > 0 AND measured_pct < 50
        UNION ALL SELECT job, 'timing', 'stretched', CASE WHEN stretched_pct >= 10 THEN 'warn' ELSE 'info' END, stretched FROM timing WHERE stretched > 0
        UNION ALL SELECT job, 'timing', 'drift', 'info', n_placed FROM timing WHERE mean_drift_ms > 500""",
    "quality_gate": f"""WITH {_ALL}, {_SCORES}, g AS (SELECT job, 'asr' AS stage, asr AS score, 55 AS threshold FROM scores UNION ALL SELECT job, 'translation', translation, 60 FROM scores UNION ALL SELECT job, 'tts', tts, 50 FROM scores)
        SELECT g.job, stage, score, coalesce(NOT (score < threshold OR (stage = 'translation' AND untranslated > 0 AND coalesce(untranslated >= greatest(n_segments, 1) * 0.1, false))), true) AS passed
        FROM g LEFT JOIN translation t ON g.job = t.job""",
    "reuse_gate": f"""WITH {SEGMENTS_SQL}, {_ARTIFACTS}, w AS (SELECT *, CASE WHEN stage = 'transcribe' AND word_conf < 0.5 THEN 'low word confidence' WHEN stage = 'transcribe' AND no_speech_ratio > 0.5 THEN 'mostly no speech'
        WHEN stage = 'translate' AND fallback_ratio > 0.05 THEN 'untranslated lines' WHEN stage = 'tts' AND failed_ratio > 0.10 THEN 'failed takes' END AS why FROM artifacts)
        SELECT job, idx, stage, why IS NULL AS ok, why FROM w""",
    "reuse_stats": f"WITH {SEGMENTS_SQL}, {_ARTIFACTS} SELECT stage, count(*) AS n, sum(idx)::BIGINT AS hits, max(job) AS latest FROM artifacts GROUP BY stage",
    "speaker_rollup": f"""WITH {SEGMENTS_SQL}, g AS (SELECT job, speaker, sum(greatest(end_ms - start_ms, 0))::BIGINT AS talk_ms, count(*) AS n FROM segments GROUP BY job, speaker)
        SELECT *, talk_ms / sum(talk_ms) OVER (PARTITION BY job) AS share, row_number() OVER (PARTITION BY job ORDER BY talk_ms DESC, speaker) AS nth FROM g""",
    "context_lines": f"WITH {SEGMENTS_SQL} SELECT job, idx, coalesce(string_agg(text, ' | ') OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM segments",
    "edit_cost": f"WITH {SEGMENTS_SQL} SELECT job, sum(end_ms - start_ms)::BIGINT AS touched_ms, count(*) AS segments FROM segments WHERE speaker = 'user' OR idx % 3 = 0 GROUP BY job",
    "repeat_lines": f"WITH {SEGMENTS_SQL} SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line, count(*) AS n, min(job * 1000 + idx) AS first FROM segments GROUP BY 1 HAVING count(*) > 1",
    "stage_report": f"""WITH {SEGMENTS_SQL}, x AS (SELECT job, idx, start_ms + dub_ms * (tier % 2) * 3 AS done_ms FROM segments)
        SELECT job, idx, done_ms, CASE WHEN max(done_ms) OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > done_ms THEN 'stale' ELSE 'done' END AS status FROM x""",
    "partial_retry": f"""WITH {SEGMENTS_SQL}, k AS (SELECT job, idx % 4 != 3 AND NOT (length(trim(text)) > 0 AND (length(trim(translated)) = 0 OR trim(translated) = trim(text))) AS keep FROM segments)
        SELECT job, count(*) FILTER (keep) AS reused, count(*) FILTER (NOT keep) AS redone FROM k GROUP BY job""",
    "qc_checklist": f"""WITH {_ALL} SELECT job, 'sync' AS "check", CASE WHEN max_stretch > 1.05 THEN 'warn' ELSE 'pass' END AS result FROM timing
        UNION ALL SELECT job, 'translation', CASE WHEN untranslated > 0 THEN 'warn' ELSE 'pass' END FROM translation
        UNION ALL SELECT job, 'voices', CASE WHEN count(DISTINCT speaker) > 2 THEN 'warn' ELSE 'pass' END FROM segments GROUP BY job""",
    "srt": f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT job, idx, text, start_ms - 400 AS s, end_ms + 100 AS e, row_number() OVER (PARTITION BY job ORDER BY idx) AS nth FROM segments),
        f AS (SELECT job, idx, nth, text, greatest(s, 0) AS a, greatest(e, greatest(s, 0) + 500) AS b FROM n WHERE nth = 1
              UNION ALL SELECT n.job, n.idx, n.nth, n.text, greatest(n.s, f.b, 0), greatest(n.e, greatest(n.s, f.b, 0) + 500) FROM f JOIN n ON n.job = f.job AND n.nth = f.nth + 1)
        SELECT job, string_agg(nth || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000)
               || chr(10) || text || chr(10), chr(10) ORDER BY nth) AS srt FROM f GROUP BY job""",
}
