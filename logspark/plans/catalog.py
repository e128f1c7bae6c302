"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logspark.plans import (
    group_queries,
    incident_queries,
    ingest_queries,
    search_queries,
    storage_queries,
    stream_queries,
    telemetry_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **ingest_queries.QUERIES,
    **group_queries.QUERIES,
    **search_queries.QUERIES,
    **incident_queries.QUERIES,
    **telemetry_queries.QUERIES,
    **stream_queries.QUERIES,
    **storage_queries.QUERIES,
}
