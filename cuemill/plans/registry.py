"""Names of all queries of the analytics operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuemill.plans import intake, media, records, settings, texts, usage

_PLANS = (usage, media, texts, records, settings, intake)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for plan in _PLANS for k, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for plan in _PLANS for k, sql in plan.ORACLES.items()}
