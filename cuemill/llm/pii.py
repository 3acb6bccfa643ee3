"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

In DataFrame operations only. Base spans of four kinds come from regular expressions and checks (Luhn, digit
counts, octets). Base spans, and a share (``SEED_PERCENT``, by hash of the value) of the opaque keys (long tokens that mix
digits and letters), seed the bootstrap. A seed isn't an answer: the other keys are what it must find.

Each occurrence of a seed or of a candidate (a token with digits) has up to four lexical patterns: two tokens to the left
with what touches the value; one token to the left, or to the right, with the value's character class and
length; what touches it on both sides, with class and length. In each round a pattern's precision is estimated as
the share of its distinct instances that are known: accepted ones count once, seeds drawn from the keys stand for
all keys of their share, and ``CAUTION`` unknown instances are added. A pattern with enough known instances and precision is
trusted, and candidates that trusted patterns introduce are accepted. Rounds end when no pattern is added. Spans of
kind ``context`` are the candidates that a trusted pattern introduced, and nothing else.

Regular expressions are possessive and begin only where a run begins (or a match ended), so they take
linear time and no recursion on long runs, and match what the plain patterns match. Matches become rows: places
are running sums over a text's matches, so the work grows in proportion to their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm._common import materialize, release


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # a cheap pattern that every text with a match contains


_LOCAL = "A-Za-z0-9._%+-"
#: The kinds in the order in which equal starts are listed.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){11}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
FOUND = "context"
_CANDIDATE = Kind(FOUND, r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+", r"[0-9]")
#: Digits of a candidate at least, and characters to the left and right in which its patterns are looked for.
LEAST_DIGITS, LEFT, RIGHT = 3, 64, 32
#: An opaque key: at least 24 characters, six digits and six letters.
_OPAQUE = r"^(?=.{24})(?=(?:[^0-9]*+[0-9]){6})(?=(?:[^A-Za-z]*+[A-Za-z]){6})"
#: Per cent of the opaque keys' values that seed, by hash.
SEED_PERCENT = 40
#: A pattern is trusted with this many distinct known instances and this precision, reckoned with so many unknown ones more.
SUPPORT, PRECISION, CAUTION = 5, 0.6, 3
#: Files of a round's trusted patterns.
PATTERN_FILES = 16
#: Characters of a piece in which text is cut for redaction.
_CUT = 4096


def _columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row, not anew wherever a lambda names them."""
    once = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", once)


_MATCH = "array<struct<rank:int,i:int,gap:int,tail:string,head:string,value:string>>"


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Structs (rank, i, gap, tail, head, value) of all matches: the characters since the last match, and the last and first of those.

    One more, without a value, holds the characters after the last match.
    """
    pieces, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), 0)

    def one(p: Column, m: Column) -> Column:
        return F.struct(F.length(p).alias("gap"), F.right(p, F.lit(LEFT)).alias("tail"), F.left(p, F.lit(RIGHT)).alias("head"), m.alias("value"))

    rows = F.transform(F.zip_with(pieces, found, one), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), *[x[c].alias(c) for c in ("gap", "tail", "head", "value")]))
    return F.when(F.regexp_like(text, F.lit(kind.guard)), rows).otherwise(F.array().cast(_MATCH))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$")))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def match_rows(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``uid`` (a number for each row) and ``raw``: all matches of all kinds. A null text has none.

    Write it before use: numbers of rows are those of one run.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = F.concat(*[_matches(whole, k, rank) for rank, k in enumerate((*KINDS, _CANDIDATE))])
    return docs.select(*keep, F.monotonically_increasing_id().alias("uid"), raw.alias("raw"))


def spans_of(raw: DataFrame, seed_percent: int = SEED_PERCENT) -> DataFrame:
    """(uid, rank, start, end, value, patterns, seed) of base spans and of candidates that overlap none, from ``match_rows``.

    ``seed``: 1 for base spans, 2 for opaque keys of the share that seeds, 0 for other candidates.
    """
    last = len(KINDS)
    rows = raw.select("uid", F.inline("raw")).repartition("uid")
    own = Window.partitionBy("uid", "rank").orderBy("i")
    before = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = lambda f, c: F.coalesce(f(c).over(own), F.lit(""))
    left = F.right(F.concat(near(F.lag, "tail"), near(F.lag, "value"), "tail"), F.lit(LEFT))
    right = F.left(F.concat(near(F.lead, "head"), near(F.lead, "value")), F.lit(RIGHT))
    rows = rows.select("uid", "rank", (before + F.col("gap")).cast("int").alias("start"), "value", left.alias("left"), right.alias("right"))
    rows = rows.where("value IS NOT NULL").withColumn("end", F.col("start") + F.length("value"))
    good = F.when(F.col("rank") == last, F.length(_digits(F.col("value"))) >= LEAST_DIGITS)
    for rank, k in enumerate(KINDS):
        good = good.when(F.col("rank") == rank, _valid(k.name, F.col("value")))
    rows = rows.where(good)
    # A candidate inside or across a base span is that span.
    is_base = F.col("rank") < last
    ahead = Window.partitionBy("uid").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(behind))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    short = F.when(F.length("value") <= LEFT, F.col("value")).otherwise(F.sha2("value", 256))
    opaque = F.regexp_like("value", F.lit(_OPAQUE)) & (F.pmod(F.xxhash64("value"), F.lit(100)) < seed_percent)
    seed = F.when(is_base, 1).when(opaque, 2).otherwise(0)
    rows = rows.where(is_base | apart)
    return rows.select("uid", "rank", "start", "end", short.alias("value"), _patterns(F.col("left"), F.col("right"), F.col("value")).alias("patterns"), seed.alias("seed"))


def _patterns(left: Column, right: Column, value: Column) -> Column:
    """The lexical patterns of an occurrence: white space as a blank, digits as 0, in lower case; without context none."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\s++", " "), "[0-9]", "0"))
    before, after = F.split(plain(left), " "), F.split(plain(right), " ")
    last = lambda n: F.trim(F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - n), n + 1), " "))
    touches, follows = F.element_at(before, -1), F.element_at(after, 1)
    first = F.trim(F.array_join(F.slice(after, 1, 2), " "))
    kinds = F.lit("x")
    for name, letters in (("w", "0-9A-Za-z"), ("U", "0-9A-F"), ("h", "0-9a-f"), ("d", "0-9")):
        kinds = F.when(F.regexp_like(value, F.lit(f"^[{letters}]++$")), name).otherwise(kinds)
    form = F.concat(kinds, F.length(value).cast("string"))
    found = F.array(
        F.when(last(2) != "", F.concat(F.lit("l2 "), last(2))),
        F.when(last(1) != "", F.concat_ws(" ", F.lit("l1"), last(1), form)),
        F.when(first != "", F.concat_ws(" ", F.lit("r1"), first, form)),
        F.when((touches != "") | (follows != ""), F.concat_ws(" ", F.lit("lr"), touches, form, follows)),
    )
    return F.array_compact(found)


def trusted_patterns(spans: DataFrame, *, rounds: int | None = None, support: int = SUPPORT, precision: float = PRECISION, seed_percent: int = 100, caution: int = 0) -> DataFrame:
    """Patterns that introduce identifiers, by iteration over the graph of patterns and instances.

    ``spans`` (pattern, value, seed): one row per occurrence. Counts are of distinct values, so copies of a text
    add nothing. An instance is known if it is a seed or if a trusted pattern introduces it; a seed with 2 that no trusted
    pattern introduces yet stands for 100 / ``seed_percent`` instances. A trusted pattern stays one, so rounds end, at the
    latest when no pattern is added; ``rounds`` ends them earlier.
    """
    edges = spans.where("pattern != ''").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = materialize(edges, "edges")
    trusted, known, turn = None, 0, 0
    while rounds is None or turn < rounds:
        if trusted is None:
            marked = edges.withColumn("hit", F.lit(None).cast("int"))
        else:
            accepted = edges.join(trusted, "pattern", "left_semi").select("value").distinct().withColumn("hit", F.lit(1))
            marked = edges.join(accepted, "value", "left")
        stands = F.when(F.col("hit").isNotNull() | (F.col("seed") == 1), 1.0).when(F.col("seed") == 2, 100 / seed_percent).otherwise(0.0)
        is_known = (F.col("hit").isNotNull() | (F.col("seed") > 0)).cast("int")
        scores = marked.groupBy("pattern").agg(F.sum(is_known).alias("good"), F.sum(stands).alias("like"), F.count(F.lit(1)).alias("all"))
        enough = (F.col("good") >= support) & (F.least("like", F.col("all").cast("double")) / (F.col("all") + caution) >= precision)
        # Few rows are left of each task's: a few files hold them.
        newer = materialize(scores.where(enough).select("pattern").repartition(PATTERN_FILES), f"patterns-{turn}")
        release(trusted)
        trusted, before, turn = newer, known, turn + 1
        known = trusted.count()
        if known == before:
            break
    return edges.select("pattern").limit(0) if trusted is None else trusted


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed_percent: int = SEED_PERCENT) -> DataFrame:
    """``doc_id``, ``row`` (a hash of key and text), ``base`` and ``found`` spans (start, rank, end) for every row of ``docs``, and ``n_seeds``.

    ``n_seeds`` counts the found spans whose value was a seed. Repeated rows have equal spans; null keys are allowed; an
    empty table gives no rows. Base spans of different kinds may overlap; found spans overlap no base span.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_t")).withColumn("row", _row_key(F.col("doc_id"), F.col("_t")))
    raw = materialize(match_rows(rows, text="_t", keep=("doc_id", "row")), "matches")
    spans = materialize(spans_of(raw.where("size(raw) > 0"), seed_percent), "spans")
    each = spans.withColumn("pattern", F.explode("patterns"))
    trusted = trusted_patterns(each.select("pattern", "value", "seed"), seed_percent=max(1, seed_percent), caution=CAUTION)
    is_base, columns = F.col("rank") < len(KINDS), ["uid", "rank", "start", "end", "seed"]
    found = each.where(~is_base).join(trusted, "pattern", "left_semi").select(columns).distinct()
    kept, place = spans.where(is_base).select(columns).unionByName(found), F.struct("start", "rank", "end")
    lists = [F.array_sort(F.collect_list(F.when(which, place))).alias(name) for which, name in ((is_base, "base"), (~is_base, "found"))]
    kept = kept.groupBy("uid").agg(*lists, F.count(F.when(~is_base & (F.col("seed") == 2), 1)).alias("n_seeds"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return raw.select("uid", "doc_id", "row").join(kept, "uid", "left").select("doc_id", "row", F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"), F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"))


def _row_key(key: Column, text: Column) -> Column:
    return F.struct(F.xxhash64(key, text), F.xxhash64(F.lit(1), text, key), F.coalesce(F.length(text), F.lit(-1)))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in (*KINDS, _CANDIDATE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def merged(found: DataFrame) -> DataFrame:
    """(row, spans): each row's spans (start, rank, end) in order, overlapping ones as one with the first's rank."""
    spans = found.select("row", F.explode(F.concat("base", "found")).alias("s")).select("row", "s.*").distinct()
    order = Window.partitionBy("row").orderBy("start", "rank", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "nth").agg(F.min("start").alias("start"), F.min_by("rank", F.struct("start", "rank", "end")).alias("rank"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by its kind in brackets; same columns.

    ``n_chars``, if there is one, is counted anew. Null texts stay null.
    """
    spans = materialize(merged(find_pii(docs, key=key, text=text)).withColumnsRenamed({"row": "_row", "spans": "_spans"}), "redactions")
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in (*KINDS, _CANDIDATE)])
    whole = F.col(text)
    rows = docs.withColumn("_row", _row_key(F.col(key).cast("long"), whole)).join(spans.hint("shuffle_hash"), "_row", "left")
    # Cut once into pieces of bounded size: a place is then found without reading the text from its start.
    rows = _columns(rows, _cut=F.when(F.col("_spans").isNotNull(), F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_CUT}}}"), 0)), _n=F.length(whole))

    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / _CUT).cast("int"), F.floor(b / _CUT).cast("int")
        head = F.substring(F.get("_cut", first), a % _CUT + 1, F.least(b - a, F.lit(_CUT)))
        middle = F.array_join(F.slice("_cut", first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.coalesce(F.substring(F.get("_cut", last), F.lit(1), b % _CUT), F.lit(""))
        return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, middle, tail))

    def piece(s: Column, i: Column) -> Column:
        return F.concat(names[s["rank"]], between(s["end"], F.coalesce(F.get("_spans", i + 1)["start"], F.col("_n"))))

    clean = F.concat(between(F.lit(0), F.get("_spans", F.lit(0))["start"]), F.array_join(F.transform("_spans", piece), ""))
    rows = rows.withColumn(text, F.when(F.col("_spans").isNotNull(), clean).otherwise(whole))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(c) for c in docs.columns])
