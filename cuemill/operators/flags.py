"""Spans of a translation that are worth a person's attention, and which of them to show.

Names and renderings meet through an inverted index (token to lines) per job: joins and counts, no pass over
a job in one task. Flags are (job, idx, start_ms, kind, reason, score, source_span, target_span, variants).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx
from cuemill.operators import phrases

#: How sure each finding is.
SCORES = {"name_inconsistent": 0.95, "glossary_miss": 0.80, "name_untransliterated": 0.60, "low_asr": 0.30}
FLAG = ["job", "idx", "start_ms", "kind", "reason", "score", "source_span", "target_span", "variants"]
ALIKE, LEAST_LINES = 0.60, 3


def _lines(segments: DataFrame) -> DataFrame:
    return segments.where(F.trim("text") != "").withColumn("translated", F.coalesce("translated", F.lit("")))


def _flag(rows: DataFrame, kind: str, reason: str, source: Column, target: Column, variants: Column) -> DataFrame:
    return rows.select("job", "idx", "start_ms", F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(SCORES[reason]).alias("score"), source.alias("source_span"), target.alias("target_span"), variants.alias("variants"))


def _settled(column: Column, settled: list[str]) -> Column:
    return F.lower(column).isin([x.lower() for x in settled] or [""])


def inconsistent_names(segments: DataFrame, *, target: str, stopwords: list[str], settled: list[str] | None = None) -> DataFrame:
    """A source name with two renderings.

    A token renders a name only if every line that holds it is one whose source holds the name. Kept as it is in
    some lines: the other rendering must be the only one. Kept nowhere: two such tokens of at least three
    lines that share no line, read alike and aren't one word inflected.
    """
    lines = _lines(segments)
    spots = lines.select("job", "idx", "start_ms", "translated", F.inline(tx.name_spots(F.col("text"), stopwords)))
    spots = spots.where(~_settled(F.col("name"), settled or []))
    spots = spots.withColumn("kept", tx.has_phrase(F.col("translated"), F.col("name")))
    named = spots.groupBy("job", "name").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("kept").alias("kept_lines"), F.bool_or(~F.col("initial")).alias("sure"),
        F.bool_and(F.trim("translated") != "").alias("whole"), F.min(F.struct("idx", "start_ms", "kept")).alias("first"),
    )
    named = named.where("sure AND whole AND lines >= 2")
    tokens = lines.select("job", "idx", F.explode(tx.target_candidates(F.col("translated"), tx.script_of(target) in tx.CASED)).alias("token"))
    spread = tokens.groupBy("job", "token").agg(F.count(F.lit(1)).alias("seen"))
    inside = spots.select("job", "idx", "name", "kept").join(named.select("job", "name"), ["job", "name"]).join(tokens, ["job", "idx"]).where(F.lower("token") != F.lower("name"))
    inside = inside.groupBy("job", "name", "token").agg(F.count(F.lit(1)).alias("within"), F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("idx")))).alias("here"))
    renderings = inside.join(spread, ["job", "token"]).where((F.col("within") == F.col("seen")) & (F.size("here") > 0)).select("job", "name", "token", "here")
    # Kept in some lines, rendered in others.
    partly = named.where("kept_lines > 0 AND kept_lines < lines")
    only = renderings.groupBy("job", "name").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("other")).where("n = 1")
    a = partly.join(only, ["job", "name"]).select("job", "name", "first.*", "other")
    a = _flag(a, "name", "name_inconsistent", F.col("name"), F.when(F.col("kept"), F.col("name")).otherwise(F.col("other")), F.array("name", "other"))
    # Kept in no line: two renderings that read alike.
    free = named.where(F.col("lines") >= LEAST_LINES).where("kept_lines = 0 OR kept_lines = lines")
    x = renderings.select("job", "name", F.col("token").alias("a"), F.col("here").alias("lines_a"))
    y = renderings.select("job", "name", F.col("token").alias("b"), F.col("here").alias("lines_b"))
    pairs = free.select("job", "name", "first").join(x, ["job", "name"]).join(y, ["job", "name"]).where("a < b").where(~F.arrays_overlap("lines_a", "lines_b"))
    pairs = pairs.where(~tx.same_stem(F.col("a"), F.col("b"))).withColumn("ratio", tx.sequence_ratio(F.lower("a"), F.lower("b"))).where(F.col("ratio") >= ALIKE)
    b = pairs.groupBy("job", "name").agg(F.min(F.struct("a", "b")).alias("p"), F.first("first").alias("first")).select("job", "name", "first.*", "p.*")
    return a.unionByName(_flag(b, "name", "name_inconsistent", F.col("name"), F.col("a"), F.array("a", "b")))


def untransliterated_names(segments: DataFrame, *, source: str, target: str, stopwords: list[str], brands: list[str], settled: list[str] | None = None) -> DataFrame:
    """A repeated Latin name left as it is in lines of another script; once per name and job, in its first such line."""
    lines = _lines(segments)
    heads = F.transform(F.regexp_extract_all("translated", F.lit(tx.WORD), 0), tx.name_head)
    words = lines.select("job", "idx", "start_ms", "text", F.posexplode(heads).alias("pos", "word")).withColumn("key", F.lower("word"))
    if tx.script_of(target) == "latin" or tx.script_of(source) == tx.script_of(target):
        words = words.limit(0)
    often = words.groupBy("job", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("job", "key")
    w = F.col("word")
    name = (F.length(w) >= 4) & (w != F.upper(w)) & F.regexp_like(w, F.lit(r"^\p{Lu}")) & tx.is_latin(w)
    known = [x.lower() for x in (*stopwords, *brands)] or [""]
    fits = name & ~F.col("key").isin(known) & ~F.regexp_replace("key", "s+$", "").isin(brands or [""]) & ~_settled(F.col("key"), settled or []) & tx.has_phrase(F.col("text"), w)
    first = words.where(fits).join(often, ["job", "key"]).groupBy("job", "key").agg(F.min(F.struct("idx", "pos", "start_ms", "word")).alias("f"))
    return _flag(first.select("job", "f.*"), "name", "name_untransliterated", F.col("word"), F.col("word"), F.array().cast("array<string>"))


def missed_terms(segments: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """Lines joined with the settled terms (term, mapped) that stand in their text while the rendering lacks in the translation."""
    some = terms.where((F.trim("term") != "") & (F.trim("mapped") != "")).select("term", "mapped")
    rows = _lines(segments).where(F.trim("translated") != "")
    return phrases.phrase_hits(rows, some, text="text", phrase="term", key=key).where(~tx.has_phrase(F.col("translated"), F.col("mapped")))


def glossary_misses(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """A settled term (term, mapped) whose rendering the translation lacks; once per term and job, in its first such line."""
    rows = missed_terms(segments, terms, ["job", "idx"])
    first = rows.groupBy("job", F.lower("term").alias("key")).agg(F.min(F.struct("idx", "start_ms", "term", "mapped")).alias("f")).select("job", "f.*")
    return _flag(first, "term", "glossary_miss", F.col("term"), F.col("mapped"), F.array("mapped"))


def unclear(segments: DataFrame) -> DataFrame:
    """Lines that the transcriber was unsure of."""
    rows = _lines(segments).where(scalars.low_confidence(F.size(F.split(F.trim("text"), r"\s+")), F.col("conf_mean"), F.col("conf_min"), F.col("logprob")))
    return _flag(rows, "unclear", "low_asr", F.left(F.trim("text"), F.lit(80)), F.lit(""), F.array().cast("array<string>"))


def best(flags: DataFrame, most: Column) -> DataFrame:
    """The best flag of each line, the best ``most`` of a job: by score, then by time."""
    order = [F.desc("score"), "start_ms", "idx", "source_span"]
    rows = flags.withColumn("nth", F.row_number().over(Window.partitionBy("job", "idx").orderBy(*order))).where("nth = 1")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("job").orderBy(*order))).where(F.col("nth") <= most)


def shown(names: DataFrame, misses: DataFrame, latin: DataFrame, faint: DataFrame, *, most: int = 5) -> DataFrame:
    """(flags, rank): decisions about names and terms first; one name left in Latin, if there is room and it asks
    nothing anew; one unclear line, where there is nothing else."""
    strong = best(names.unionByName(misses), F.lit(most)).select(*FLAG, "nth")
    held = strong.groupBy("job").agg(F.count(F.lit(1)).alias("held"), F.collect_set("idx").alias("used"), F.collect_set(F.lower("source_span")).alias("asked"))
    rest = latin.join(held, "job", "left").where(F.coalesce(~F.array_contains("used", F.col("idx")) & ~F.array_contains("asked", F.lower("source_span")) & (F.col("held") < most), F.lit(True)))
    second = best(rest, F.lit(1)).select(*FLAG, (F.col("nth") + F.coalesce("held", F.lit(0))).cast("int").alias("nth"))
    taken = strong.unionByName(second)
    third = best(faint.join(taken.select("job").distinct(), "job", "left_anti"), F.lit(1)).select(*FLAG, "nth")
    return taken.unionByName(third).withColumnRenamed("nth", "rank")
