"""Phrases in texts through an index: no pair of a text and a phrase is looked at unless they share a key.

A phrase stands in a text between characters that aren't letters, whatever its case (``text.has_phrase``). So its runs of
letters are whole runs of the text, one after the other: the run sequences of a text that are as long as some phrase's meet
the phrases by equality. A phrase without letters (a number, a sign) meets texts by its first characters that aren't
letters. What meets is then checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import text as tx
from cuemill.operators.rows import once

#: Characters of a phrase without letters that are its key, at most.
SIGNS = 3
#: Phrases, and their bytes, up to which they are sent to all tasks; the texts' keys, many for each text, never are.
SMALL_ROWS, SMALL_BYTES = 50_000, 4 << 20


def _folded(text: Column) -> Column:
    """Equal for texts that a search without regard to case takes for equal."""
    return F.lower(F.upper(F.lower(F.translate(text, "İ", "i"))))


def _keyed(phrases: DataFrame, phrase: str) -> DataFrame:
    """``phrases`` with ``_size`` (runs of letters; below zero: characters) and ``_key`` (a hash: what meets is checked)."""
    runs, signs = F.regexp_extract_all(F.col(phrase), F.lit(r"\p{L}+"), 0), F.left(F.trim(phrase), F.lit(SIGNS))
    size = F.when(F.size(runs) > 0, F.size(runs)).otherwise(-F.length(signs))
    return phrases.where(F.trim(phrase) != "").select("*", size.alias("_size"), F.xxhash64(_folded(F.when(F.size(runs) > 0, F.array_join(runs, " ")).otherwise(signs))).alias("_key"))


def _grams(items: Column, n: int, glue: str) -> Column:
    """All sequences of ``n`` items, joined."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), glue))


def _text_keys(rows: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """``_row``, ``_size``, ``_key`` of the rows' texts, each key once a row, for the sizes that phrases have."""
    rows = once(rows.select("_row", text), _runs=F.regexp_extract_all(_folded(F.col(text)), F.lit(r"\p{L}+"), 0), _signs=F.filter(F.split(F.col(text), r"\p{L}+"), lambda x: x != ""))
    # A lambda's parameters are the element and its place: sizes come in from outside.
    found = [F.transform(F.array_distinct(_grams(F.col("_runs"), n, " ") if n > 0 else _pieces(F.col("_signs"), -n)), _struct_of(n)) for n in sizes]
    return rows.select("_row", F.inline(F.concat(F.array().cast("array<struct<_size:int,_key:bigint>>"), *found)))


def _struct_of(n: int):
    return lambda key: F.struct(F.lit(n).alias("_size"), F.xxhash64(key).alias("_key"))


def _pieces(signs: Column, n: int) -> Column:
    """All sequences of ``n`` characters within the items."""
    each = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.filter(F.flatten(F.transform(signs, each)), lambda g: F.length(g) == n)


def phrase_hits(rows: DataFrame, phrases: DataFrame, *, text: str, phrase: str, key: list[str]) -> DataFrame:
    """Rows of ``rows`` joined with the ``phrases`` that stand in their text.

    ``key`` names the columns by which rows are told apart. Null and blank texts and phrases meet nothing. Columns of both
    tables must differ in name. The number of different phrase lengths bounds the passes over a text's words, not their number.
    """
    keyed = _keyed(phrases, phrase)
    bytes_of = sum((F.octet_length(F.col(c).cast("string")) for c, t in phrases.dtypes if t == "string"), F.lit(0))
    counts = keyed.groupBy("_size").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("b")).collect()  # lengths in words: a few
    sizes = sorted(r["_size"] for r in counts)
    small = sum(r["n"] for r in counts) <= SMALL_ROWS and sum(r["b"] or 0 for r in counts) <= SMALL_BYTES
    told = rows.withColumn("_row", F.struct(*key))
    keys = _text_keys(told.where(F.col(text).isNotNull()), text, sizes)
    # Spark reckons with the size of the texts' file, not with what is made of it, so both joins say how.
    near = keys.join(F.broadcast(keyed) if small else keyed.hint("merge"), ["_size", "_key"]).drop("_size", "_key")
    near = near.repartition("_row").distinct()
    return told.join(near.hint("merge"), "_row").where(tx.has_phrase(F.col(text), F.col(phrase))).drop("_row")
