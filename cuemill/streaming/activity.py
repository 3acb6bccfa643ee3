"""The activity stream: redaction, daily usage, bounded rings, sessions, line assembly.

Functions take a streaming (or batch) DataFrame and return one; ``run_available`` processes what is there and
stops, which also serves as a flush barrier.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cuemill.functions import scalars


def watch_folder(spark: SparkSession, folder: str, schema: StructType | str, *, files_per_batch: int = 100) -> DataFrame:
    """Each new Parquet file of a folder once; ``maxFilesPerTrigger`` bounds a batch instead of dropping events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Time zone-less times can't carry a watermark, so they become instants (UTC session)."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def redacted(events: DataFrame, *columns: str) -> DataFrame:
    return events.withColumns({c: scalars.redact_secrets(F.col(c)) for c in columns})


def daily_usage(events: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Minutes (as DECIMAL) and events per day."""
    e = with_event_time(events).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(F.col("value").cast("decimal(18,3)")).alias("m"), F.count(F.lit(1)).alias("jobs"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("bucket"), F.col("m").cast("double").alias("minutes"), "jobs")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Per user: spans of activity without a longer pause. Without ``late`` no event is too late (for complete output)."""
    e = with_event_time(events)
    if late is not None:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def ring(events: DataFrame, *, keep: int = 4) -> DataFrame:
    """Per user the newest ``keep`` event ids and how many older ones were evicted; state holds only the ring."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, gone = state.get if state.exists else ([], 0)
        ids = list(ids)
        for rows in batches:
            ids += rows["event_id"].tolist()
            ids.sort()
            gone += max(0, len(ids) - keep)
            ids = ids[-keep:]
        state.update((ids, gone))
        yield pd.DataFrame({"user_id": [key[0]], "newest": [ids], "evicted": [gone]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, newest array<long>, evicted long", "ids array<long>, gone long", "update", GroupStateTimeout.NoTimeout)


def assemble_lines(chunks: DataFrame, *, longest: int = 8192) -> DataFrame:
    """(stream, line): whole lines from partial writes (stream, seq, data); after a carriage return only what follows counts."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        out = []
        for rows in batches:
            for data in rows.sort_values("seq")["data"]:
                *whole, rest = (rest + data).split("\n")
                if len(rest) > longest:
                    whole, rest = [*whole, rest], ""
                out += [x.rstrip("\r").rpartition("\r")[2] for x in whole]
        state.update((rest,))
        yield pd.DataFrame({"stream": [key[0]] * len(out), "line": out})

    return chunks.groupBy("stream").applyInPandasWithState(update, "stream long, line string", "rest string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, *, mode: str = "append", name: str | None = None) -> None:
    """Process all there is, exactly once per checkpoint folder, and wait.

    ``update`` and ``complete`` go to ``out/batch=N``, or with a name to a memory table (on the driver, for small results).
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is tried again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    if name:
        writer = writer.format("memory").queryName(name)
    elif mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(write)
    writer.start().awaitTermination()


def deliver(stream: DataFrame, folder: str, hooks: DataFrame, *, attempts: int = 2) -> None:
    """A delivery log: each event for each enabled hook that subscribes to its type, written per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.join(hooks.where("enabled").withColumn("event_type", F.explode(F.array_distinct("events"))), "event_type")
        body = F.to_json(F.struct("event_id", "event_type", "value"))
        wanted.select("hook_id", "event_id", "event_type", body.alias("payload"), F.lit(attempts).alias("attempts"), F.lit(batch_id).alias("batch")).write.mode("append").parquet(f"{folder}/deliveries")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/delivery-checkpoint").foreachBatch(write).start().awaitTermination()
