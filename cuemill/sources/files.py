"""File sources: job tables, JSON folders, JSON lines, ranked feeds, stage checkpoints, scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuemill.functions import scalars
from cuemill.functions import text as tx


def parse_jobs(rows: DataFrame, schema: str, data: str = "data") -> DataFrame:
    """Rows whose JSON can be parsed, as columns; bad rows are left out."""
    parsed = rows.withColumn("j", F.from_json(data, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("j IS NOT NULL AND j._bad IS NULL").select(*[c for c in rows.columns if c != data], "j.*").drop("_bad")


def json_folder(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One document per file; the id is the document's or else the file's stem; the first of an id stays."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    rows = rows.withColumn("id", F.coalesce(F.col("id"), stem)).withColumn("_file", F.col("_metadata.file_name"))
    best = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("id", "_file")]), "_file").alias("r"))
    return best.select("id", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are JSON objects; blank and malformed ones are left out."""
    lines = spark.read.text(path).where("trim(value) != ''")
    return parse_jobs(lines, schema, "value")


def ranked_feed(lines: DataFrame, *, shorts: bool = False) -> DataFrame:
    """A feed (pos, value) of JSON lines with ranks by position among the lines that count."""
    schema = "id string, title string, duration string, view_count long, is_short int, category_id int"
    rows = parse_jobs(lines, schema, "value").where("id IS NOT NULL")
    rows = rows if shorts else rows.where("coalesce(is_short, 0) = 0")
    # A feed is one bounded document, so one window over it is fine.
    return rows.select(F.row_number().over(Window.orderBy("pos")).alias("rank"), "id", "title", scalars.parse_duration(F.col("duration")).alias("seconds"), "view_count", (F.col("category_id") == 10).alias("is_music"))


def checkpoints(spark: SparkSession, folder: str, stages: list[str], schema: str) -> DataFrame:
    """One row per (job, stage) whose file <folder>/<job>/<stage>.json can be read, with the stage's order."""
    order = spark.createDataFrame([(s, i) for i, s in enumerate(stages)], "stage string, nth int")
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    raw = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("job"), F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("stage"), "value")
    return parse_jobs(raw, schema, "value").join(F.broadcast(order), "stage")


#: The forms of a script's lines (a pause stands in a comment of its own).
PAUSE = r"(?im)^[ \t]*<!--\s*pause\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*-->[ \t]*$"
HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
IMAGE = r"^!\[[^\]]*\]\(\s*([^)\s]+)(?:\s+\"[^\"]*\")?\s*\)$"
ITEM = r"^(?:[-*+]|\d+[.)])\s+"
LONGEST_PAUSE = 30.0
#: Comments that fill lines of their own, and others; marks of quotations.
_OWN_COMMENT, _COMMENT, _QUOTED = r"(?m)^[ \t]*<!--(?s:.*?)-->[ \t]*(?:\n|\z)", r"<!--(?s:.*?)(?:-->|\z)", r"^>[> ]*"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _joined(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _script_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, kind, level, value) of a Markdown script's lines; kinds: heading, image, pause, words, blank, none."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PAUSE, "\0$1"), _OWN_COMMENT, ""), _COMMENT, " ")
    lines = rows.select(key, F.posexplode(F.split(marked, r"\r\n|\n|\r")).alias("n", "raw")).select(key, "n", _trimmed(F.col("raw")).alias("line"))
    line, words = F.col("line"), tx.strip_markup(F.regexp_replace(F.regexp_replace("line", ITEM, ""), _QUOTED, ""))
    kind = F.when(line == "", "blank").when(F.startswith(line, F.lit("\0")), "pause").when(F.regexp_like(line, F.lit(HEADING)), "heading").when(F.regexp_like(line, F.lit(IMAGE)), "image")
    value = F.when(F.col("kind") == "pause", F.substring(line, 2, 20)).when(F.col("kind") == "heading", tx.strip_markup(F.regexp_extract(line, HEADING, 2)))
    value = value.when(F.col("kind") == "image", F.regexp_extract(line, IMAGE, 1)).when(F.col("kind") == "words", words)
    lines = lines.withColumn("kind", kind.when(words != "", "words").otherwise("none"))
    return lines.select(key, "n", "kind", F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), value.alias("value"))


def _markdown_slides(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, id, title, image, pause_after, paragraphs): a slide begins at each heading but the script's title.

    The title is a heading of level 1 ahead of all else; what stands before the first slide is a slide with that title. A
    heading or a blank line ends a paragraph.
    """
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = _script_lines(rows, key, text)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    lines = lines.withColumn("shown", F.count_if(~is_("blank", "none")).over(so_far))
    lines = lines.withColumn("opens", is_("heading") & ~((F.col("level") == 1) & (F.col("shown") == 1)))
    lines = lines.withColumns({"nth": F.count_if("opens").over(so_far), "breaks": F.count_if(is_("heading", "blank")).over(so_far)})
    lines = lines.withColumn("whole", F.max(F.when(is_("heading") & ~F.col("opens"), F.col("value"))).over(Window.partitionBy(key)))
    said = Window.partitionBy(key, "nth", "kind").orderBy("n")
    fresh = is_("words") & F.coalesce(F.lag("breaks").over(said) != F.col("breaks"), F.lit(True))
    lines = lines.withColumn("fresh", fresh).withColumn("paragraph", F.when(is_("words"), F.count_if("fresh").over(said.rowsBetween(Window.unboundedPreceding, 0))))
    lines = lines.where(~is_("blank", "none") & (~is_("heading") | F.col("opens")))
    of = lambda k: F.when(is_(k), F.col("value"))
    ordered = lambda first, then: F.transform(F.array_sort(F.collect_list(F.when(F.col(then).isNotNull(), F.struct(first, then)))), lambda x: x[then])
    parts = lines.withColumn("spoken", of("words")).groupBy(key, "nth", "paragraph").agg(
        F.max(of("heading")).alias("heading"), F.max("whole").alias("whole"), F.min_by(of("image"), F.when(is_("image"), F.col("n"))).alias("image"),
        F.max_by(of("pause"), F.when(is_("pause"), F.col("n"))).alias("pause"), F.array_join(ordered("n", "spoken"), " ").alias("spoken"),
    )
    parts = parts.withColumn("spoken", F.when(F.col("paragraph").isNotNull(), F.col("spoken")))
    slides = parts.groupBy(key, "nth").agg(F.max("heading").alias("heading"), F.max("whole").alias("whole"), F.max("image").alias("image"), F.max("pause").cast("double").alias("pause_after"), ordered("paragraph", "spoken").alias("paragraphs"))
    title = F.coalesce(F.when(F.col("nth") == 0, F.col("whole")).otherwise(F.col("heading")), F.lit(""))
    return slides.select(key, "nth", F.lit("").alias("id"), title.alias("title"), "image", "pause_after", "paragraphs")


def _json_slides(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The same from JSON: a list, or an object with a list ``slides``, of texts or objects; none from what can't be read."""
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)
    read = rows.select(key, F.try_parse_json(F.col(text)).alias("v"))
    many = F.coalesce(at(F.col("v"), "$", "array<variant>"), at(F.col("v"), "$.slides", "array<variant>"))
    each = read.select(key, F.posexplode(many).alias("nth", "e")).withColumn("form", F.schema_of_variant("e"))
    e = F.col("e")
    said = F.coalesce(at(e, "$.narration", "variant"), at(e, "$.paragraphs", "variant"), at(e, "$.text", "variant"))
    each = each.withColumn("said", F.when(F.col("form") == "STRING", e).otherwise(said))
    parts = F.coalesce(at(F.col("said"), "$", "array<string>"), F.array(at(F.col("said"), "$", "string")))
    paragraphs = F.flatten(F.transform(F.array_compact(parts), lambda x: F.split(x, r"\n\s*\n")))
    paragraphs = F.filter(F.transform(paragraphs, _joined), lambda x: x != "")
    some = lambda path, kind: F.when(F.startswith(F.col("form"), F.lit("OBJECT")), at(e, path, kind))
    text_of = lambda path: F.coalesce(some(path, "string"), F.lit(""))
    empty = F.array().cast("array<string>")
    return each.select(key, F.col("nth").cast("long").alias("nth"), F.trim(text_of("$.id")).alias("id"), _joined(text_of("$.title")).alias("title"), text_of("$.image").alias("image"), some("$.pause_after", "double").alias("pause_after"), F.coalesce(paragraphs, empty).alias("paragraphs"))


def _slide_ids(slides: Column) -> Column:
    """Each slide's own id, else its title's slug, else its number; one that was given before gets the next free number."""

    def next_id(ids: Column, s: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(ids) + 2), lambda k: F.concat(F.left(s["base"], F.lit(60)), F.lit("-"), k.cast("string"))), lambda x: ~F.array_contains(ids, x))
        return F.array_append(ids, F.when(F.array_contains(ids, s["base"]), free[0]).otherwise(s["base"]))

    dashes = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    slug = lambda s: dashes(F.left(dashes(F.lower(F.regexp_replace(s["title"], "[^A-Za-z0-9]+", "-"))), F.lit(48)))
    bases = F.transform(slides, lambda s, i: F.struct(F.coalesce(F.nullif(s["id"], F.lit("")), F.nullif(slug(s), F.lit("")), F.concat(F.lit("slide-"), (i + 1).cast("string"))).alias("base")))
    return F.aggregate(bases, F.array().cast("array<string>"), next_id)


def scripts(rows: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, id, title, image, pause_after, paragraphs): the slides of Markdown or JSON scripts, by unique keys.

    A null, empty or unreadable script has no slides. Lines are rows: slides and paragraphs are running counts over them.
    """
    # Away from names that the parts use.
    rows = rows.select(F.col(key).alias("_key"), _trimmed(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    is_json = F.regexp_like("_text", F.lit(r"^[{\[]"))
    slides = _json_slides(rows.where(is_json), "_key", "_text").unionByName(_markdown_slides(rows.where(~is_json), "_key", "_text"))
    columns = ["nth", "id", "title", "image", "pause_after", "paragraphs"]
    whole = slides.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("slides"))
    whole = whole.select("_key", "slides", F.posexplode(F.arrays_zip(_slide_ids(F.col("slides")).alias("ids"), F.col("slides").alias("s"))).alias("position", "x"))
    s = F.col("x.s")
    image = F.regexp_extract(F.replace(F.coalesce(s["image"], F.lit("")), F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    pause = F.least(F.lit(LONGEST_PAUSE), F.greatest(F.lit(0.0), s["pause_after"]))
    return whole.select(F.col("_key").alias(key), "position", F.col("x.ids").alias("id"), s["title"].alias("title"), image.alias("image"), F.when(s["pause_after"].isNotNull(), pause).alias("pause_after"), s["paragraphs"].alias("paragraphs"))


def fixtures(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Documents of a folder that have the shape of a fixture: an id and segments."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).where("id IS NOT NULL AND segments IS NOT NULL")


def file_hashes(spark: SparkSession, path: str, *, prefix: int = 0) -> DataFrame:
    """(path, hash) of files: SHA-256 of their size in decimal digits and their bytes (the first ``prefix``, if given)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    content = F.substring("content", F.lit(1), F.lit(prefix)) if prefix else F.col("content")
    return files.select("path", F.sha2(F.concat(F.col("length").cast("string").cast("binary"), content), 256).alias("hash"))
