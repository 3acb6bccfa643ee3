"""Similar titles: a similarity join under the matching-blocks ratio, and duplicates by title and duration.

The ratio of two titles is 2 M / T with T their lengths together and M the characters in matching blocks. M can't exceed the
shorter title nor the characters that both have, counted with repeats. So a title is a set of numbered characters
(the second "a" is "a2"), rarest first, and two titles can only reach the ratio if their first few share an
element (prefix filter), at places that leave enough behind them, and then share enough in all. Only what passes these bounds
gets the exact ratio. Equal titles are one: pairs are of different titles, and durations are kept as
ranges of each title, so no group of copies is expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import scalars
from cuemill.functions import text as tx
from cuemill.operators.rows import once
from cuemill.sources import scratch


def _elements(titles: DataFrame) -> DataFrame:
    """(title, n, elements): each title's numbered characters, the rarest in all titles first."""
    letters = F.array_sort(F.regexp_extract_all("title", F.lit(r"(?s)."), 0))
    rows = once(titles, _letters=letters)
    # Sorted letters: a letter's number is its place behind the first of its kind.
    numbered = F.transform("_letters", lambda c, i: F.concat(c, (i + 1 - F.array_position("_letters", c)).cast("string")))
    rows = scratch.written(rows.select("title", F.size("_letters").alias("n"), numbered.alias("e")), "titles")
    each = rows.select("title", "n", F.explode("e").alias("e"))
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(often, "e").groupBy("title", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("x"))
    return scratch.written(ranked.select("title", "n", F.col("x.e").alias("elements")), "elements")


def _prefix(n: Column, percent: int) -> Column:
    """How many of a title's ``n`` elements must include one that a similar title's prefix shares."""
    shortest = F.ceil(n * percent / (200 - percent))
    return (n - F.ceil((n + shortest) * percent / 200) + 1).cast("int")


def similar_titles(titles: DataFrame, *, percent: int = 60) -> DataFrame:
    """(a, b, ratio): ordered pairs of different titles (column ``title``) with a ratio of at least ``percent`` / 100.

    Null and empty titles are similar to nothing; repeated ones count once.
    """
    rows = _elements(titles.where("title != ''").select("title").distinct())
    heads = rows.select("title", "n", F.posexplode(F.slice("elements", F.lit(1), _prefix(F.col("n"), percent))).alias("p", "e"))
    side = lambda s: heads.select("e", *[F.col(c).alias(f"{c}_{s}") for c in ("title", "n", "p")])
    enough = lambda shared: shared * 200 >= (F.col("n_a") + F.col("n_b")) * percent
    near = side("a").join(side("b"), "e").where("title_a != title_b").where(enough(F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))))
    near = near.select("title_a", "title_b").distinct()
    of = lambda s: rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("title", "n", "elements")])
    both = near.join(of("a"), "title_a").join(of("b"), "title_b").where(enough(F.size(F.array_intersect("elements_a", "elements_b"))))
    scored = both.select(F.col("title_a").alias("a"), F.col("title_b").alias("b"), tx.sequence_ratio("title_a", "title_b").alias("ratio"))
    return scored.where(F.col("ratio") >= percent / 100)


def duplicate_titles(rows: DataFrame, *, percent: int = 60, tolerance: float = 5.0) -> DataFrame:
    """(id, best, verdict) of each of ``rows`` (id, title, seconds) against all others.

    ``best`` is the highest ratio to another row's title whose duration is unknown or differs by at most ``tolerance``; null
    if none reaches ``percent`` / 100 (with another duration a score is at most a half, so it couldn't). Ids must
    be unique; a null or blank title is like nothing.
    """
    rows = scratch.written(rows.select("id", scalars.normalise_title(F.col("title")).alias("title"), F.col("seconds").cast("double").alias("seconds")), "rows")
    real = rows.where("title != ''")
    alike = similar_titles(real, percent=percent)
    alike = scratch.written(alike.unionByName(real.select(F.col("title").alias("a"), F.col("title").alias("b"), F.lit(1.0).alias("ratio")).distinct()), "alike")
    # Ranges of each title's durations by their multiple of the tolerance; "none": unknown ones; "any": all.
    place = F.floor(F.col("seconds") / tolerance)
    spots = F.when(F.col("seconds").isNull(), F.array(F.lit("none"), F.lit("any"))).otherwise(F.array(place.cast("string"), F.lit("any")))
    known = real.select("title", "seconds", F.explode(spots).alias("spot")).groupBy(F.col("title").alias("b"), "spot").agg(F.min("seconds").alias("low"), F.max("seconds").alias("high"), F.count(F.lit(1)).alias("n"))
    ask = lambda spot, own: F.struct(spot.alias("spot"), F.lit(own).alias("own"))
    near = [ask((place + k).cast("string"), k == 0) for k in (-1, 0, 1)]
    asked = F.when(F.col("seconds").isNull(), F.array(ask(F.lit("any"), True))).otherwise(F.array(ask(F.lit("none"), False), *near))
    # Rows of a title with the same duration have the same answer.
    asking = real.select(F.col("title").alias("a"), "seconds").distinct().select("a", "seconds", F.inline(asked))
    met = asking.join(alike, "a").join(known, ["b", "spot"])
    others = F.col("n") - F.when(F.col("own") & (F.col("a") == F.col("b")), 1).otherwise(0)
    close = F.col("spot").isin("none", "any") | ((F.col("low") <= F.col("seconds") + tolerance) & (F.col("high") >= F.col("seconds") - tolerance))
    best = met.where((others > 0) & close).groupBy(F.col("a").alias("title"), F.col("seconds").alias("_s")).agg(F.max("ratio").alias("best"))
    out = rows.join(best, (rows["title"] == best["title"]) & rows["seconds"].eqNullSafe(best["_s"]), "left").select("id", "best")
    return out.withColumn("verdict", tx.duplicate_verdict(F.coalesce("best", F.lit(0.0))))
