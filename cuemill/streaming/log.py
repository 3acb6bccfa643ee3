"""Sinks that keep a log: gapless ids, the newest entries, one issue for each error signature.

Each micro-batch writes tables of its own (``batch=N``) and overwrites them if it is tried again; what it adds to is what
earlier batches wrote. So a repeated batch changes nothing, and a stream that is stopped and started again goes on as if
it had run once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cuemill.functions import scalars

_ROW_BITS = 33


def _read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What batches wrote below ``path`` (those before a number, if given); None if there is nothing."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def _write(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    where = f"{path}/batch={batch_id}"
    rows.write.mode("overwrite").parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)


def append_batch(batch: DataFrame, batch_id: int, folder: str, *, order: list[str], secret: list[str]) -> DataFrame:
    """Append a batch to ``folder/log`` with ids that follow the last ones without a gap, in ``order``; returns what was written.

    Secrets in the columns ``secret`` are replaced before anything is written. Numbers come in two levels: a row's within
    its range of the order, and how many rows the ranges before have.
    """
    spark = batch.sparkSession
    rows = batch.withColumns({c: scalars.redact_secrets(F.col(c)) for c in secret})
    keys = [F.col(c) for c in order] + [F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    dealt = _write(dealt, f"{folder}/staged", batch_id)
    ranges = dealt.groupBy(F.shiftright("_m", _ROW_BITS).alias("_range")).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    earlier = _read(spark, f"{folder}/last", batch_id)
    last = 0 if earlier is None else earlier.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    begins = ranges.withColumn("_before", F.lit(last) + F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = dealt.withColumn("_range", F.shiftright("_m", _ROW_BITS)).join(F.broadcast(begins.drop("n")), "_range")
    numbered = numbered.withColumn("id", (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).cast("long")).select("id", *rows.columns)
    out = _write(numbered, f"{folder}/log", batch_id)
    _write(out.agg(F.coalesce(F.max("id"), F.lit(last)).cast("long").alias("last")), f"{folder}/last", batch_id)
    return out


def newest(spark: SparkSession, folder: str, capacity: int = 600) -> DataFrame | None:
    """The newest ``capacity`` entries of a log, by id: what a restarted feed begins with. None without a log."""
    log = _read(spark, f"{folder}/log")
    return None if log is None else log.orderBy(F.desc("id")).limit(capacity)


def feed_batch(added: DataFrame, batch_id: int, folder: str, *, capacity: int = 600) -> None:
    """Keep the feed ``folder/feed``: the newest ``capacity`` of what the last batch kept and what a batch has added to the log.

    The first batch of a feed without tables of its own (a lost or new one) begins with the newest entries of the log.
    """
    spark = added.sparkSession
    kept = _read(spark, f"{folder}/feed", batch_id)
    if kept is None or kept.isEmpty():
        log = _read(spark, f"{folder}/log", batch_id)
        rows = added if log is None else added.unionByName(log.select(*added.columns))
    else:
        last = kept.agg(F.max("batch")).first()[0]
        rows = added.unionByName(kept.where(F.col("batch") == last).select(*added.columns))
    _write(rows.orderBy(F.desc("id")).limit(capacity), f"{folder}/feed", batch_id)


def issue_batch(reports: DataFrame, batch_id: int, folder: str, *, order: list[str], title: Column) -> None:
    """Deliver reports (signature and others): the first of a signature opens an issue, later ones are comments on it.

    ``folder/issues`` holds signature and issue (the number of the report in ``order`` that opened it, from 1, with its batch),
    ``folder/deliveries`` each report with its action. A report without a signature opens an issue of its own.
    """
    spark = reports.sparkSession
    known = _read(spark, f"{folder}/issues", batch_id)
    rows = reports.withColumn("signature", F.coalesce("signature", F.lit(""))).withColumn("title", title)
    by = F.struct(*order)
    opened = rows.where("signature != ''").groupBy("signature").agg(F.min(by).alias("_first"))
    if known is not None:
        opened = opened.join(known.select("signature"), "signature", "left_anti")
    opened = _write(opened.select("signature", F.concat_ws("-", F.lit("issue"), *[F.col(f"_first.{c}").cast("string") for c in order]).alias("issue"), "_first"), f"{folder}/issues", batch_id)
    every = opened if known is None else opened.unionByName(known.select(*opened.columns))
    told = rows.join(every, "signature", "left")
    first = F.col("_first").isNull() | (F.col("_first") == by)
    fresh = first if known is None else first & (F.col("_first").isNull() | ~F.col("_old"))
    told = told.withColumn("_old", F.lit(False)) if known is None else told.join(known.select("signature", F.lit(True).alias("_old")), "signature", "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    own = F.concat_ws("-", F.lit("issue"), *[F.col(c).cast("string") for c in order])
    out = told.select("signature", *order, F.coalesce("issue", own).alias("issue"), F.when(fresh, "created").otherwise("commented").alias("action"), F.when(fresh, F.col("title")).alias("title"))
    _write(out, f"{folder}/deliveries", batch_id)


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process all there is in micro-batches, and wait; a later call goes on behind them."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start().awaitTermination()


def run_log(stream: DataFrame, folder: str, *, order: list[str], secret: list[str], capacity: int = 600) -> None:
    """A stream into a log and its feed of the newest entries."""

    def write(batch: DataFrame, batch_id: int) -> None:
        feed_batch(append_batch(batch, batch_id, folder, order=order, secret=secret), batch_id, folder, capacity=capacity)

    run_batches(stream, folder, write)


def feed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The feed as the last batch left it."""
    kept = _read(spark, f"{folder}/feed")
    return None if kept is None else kept.where(F.col("batch") == kept.agg(F.max("batch")).first()[0]).drop("batch")
