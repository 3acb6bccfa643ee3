"""Stored jobs: a JSON document each, with columns taken from it and a layout by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def taken(data: Column) -> dict[str, Column]:
    """The columns that a job's JSON gives: status, created, batch_id; null where it lacks them or can't be read."""
    v = F.try_parse_json(data)
    return {"status": F.try_variant_get(v, "$.status", "string"), "created": F.try_variant_get(v, "$.created", "double"), "batch_id": F.try_variant_get(v, "$.batch_id", "string")}


def store_jobs(rows: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write jobs (id, data) with the columns of their JSON, in a folder for each status, by time within a file.

    So a scan for a status reads its folder alone, and one for a span of time the row groups that overlap it.
    """
    out = rows.select("id", "data").withColumns(taken(F.col("data")))
    out.repartitionByRange("status", "created", "id").sortWithinPartitions("status", "created", "id").write.mode(mode).partitionBy("status").parquet(path)


def stored_jobs(spark: SparkSession, path: str, *, status: list[str] | None = None, since: float | None = None, batch_id: str | None = None) -> DataFrame:
    """Stored jobs, all or those of some statuses, of a time on, of a batch."""
    # The schema is given, as a status like "2024" would be read as a number.
    rows = spark.read.schema("id string, data string, created double, batch_id string, status string").parquet(path)
    if status is not None:
        rows = rows.where(F.col("status").isin(status))
    if since is not None:
        rows = rows.where(F.col("created") >= since)
    return rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)
