"""Streaming forms of the operators whose state grows line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import fingerprint, severity_of_level
from logspark.operators import grouping, parsing, telemetry

GROUP_KEYS = grouping.IDENTITY


def streaming_groups(lines: DataFrame, formats: DataFrame, year: int) -> DataFrame:
    """Running count and time range per file and template.

    Formats come from a static table, because detection needs the head of a
    file.  The state is one row per group and never expires: files arrive in any
    order, so no line may be dropped for being late.
    """
    parsed = parsing.parse_lines(parsing.attach_formats(lines, formats), year)
    return grouping.group_counts(grouping.error_lines(parsed))


def windowed_groups(
    lines: DataFrame, formats: DataFrame, year: int, window: str, watermark: str = fixed.WATERMARK
) -> DataFrame:
    """Groups per time window, for live input in rough time order; state expires."""
    parsed = parsing.parse_lines(parsing.attach_formats(lines, formats), year)
    errors = grouping.error_lines(parsed).withWatermark("ts", watermark)
    return errors.groupBy(F.window("ts", window), *GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def finish_groups(state: DataFrame) -> DataFrame:
    """Fingerprint and severity, computed once per stored group."""
    return state.select(
        "file_id",
        fingerprint(F.col("level"), F.col("template")).alias("fingerprint"),
        *GROUP_KEYS[1:],
        severity_of_level(F.col("level")).alias("severity"),
        "count",
        "first_seen",
        "last_seen",
    )


def streaming_red(
    requests: DataFrame, window: str, slide: str, watermark: str = fixed.WATERMARK
) -> DataFrame:
    """Requests, errors and durations per window, method and route."""
    rows = telemetry.measured(requests).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", window, slide), *telemetry.SERIES).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum(F.col("duration_s").cast("decimal(18,6)")).alias("seconds"),
    )


def streaming_steps(
    requests: DataFrame, keys: list[str], step_s: int, watermark: str = fixed.WATERMARK
) -> DataFrame:
    """Sums per key and step; alert intervals are computed over the stored steps."""
    rows = telemetry.measured(requests).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", f"{step_s} seconds"), *keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum(F.col("duration_s").cast("decimal(18,6)")).alias("seconds"),
    )


def steps_of_state(state: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """Stored step windows in the form the batch alert operators take."""
    step = F.floor(F.unix_seconds("window.start") / step_s).cast("long")
    return state.select(*keys, step.alias("step"), "requests", "errors", "seconds")


def dedup_redelivered(
    rows: DataFrame, keys: list[str], time: str = "ts", watermark: str = fixed.WATERMARK
) -> DataFrame:
    """Drop rows that a replayed task delivers again within the watermark."""
    return rows.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)
