"""Registered queries over enriched groups: timeline, causal check, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators import incident, report, serving
from logspark.plans import inputs
from logspark.plans.ingest_queries import shown_time

GENERATED_AT = "2024-02-01 00:00 UTC"


def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = incident.timeline(inputs.enriched_groups(spark, sf_dir))
    ordered = events.orderBy("file_id", *incident.timeline_order())
    return ordered.select(
        "file_id", "group_id", "label", "severity", "count", shown_time("first_seen"),
        shown_time("last_seen"), "is_first_failure",
    )


def _investigations(spark: SparkSession, sf_dir: str, labelled: bool) -> DataFrame:
    groups = inputs.enriched_groups(spark, sf_dir)
    if not labelled:
        groups = groups.withColumn("payload", F.when(F.lit(False), F.col("payload")))
    runs = serving.completed_runs(inputs.runs(spark, sf_dir))
    events = incident.timeline(groups).join(runs.select("file_id"), "file_id", "left_semi")
    return incident.investigate(runs, events, subjects=fixed.PLAN_SUBJECTS, downstream_labels=fixed.DOWNSTREAM_LABELS)


def investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _investigations(spark, sf_dir, labelled=True)
    return checked.select(
        "file_id",
        "event_count",
        F.array_join("plan", " | ").alias("plan"),
        F.array_join("findings", " ").alias("findings"),
        "verified",
        "confidence",
        "conclusion",
    )


def newest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of two investigations per run, without and with labels."""
    first = _investigations(spark, sf_dir, labelled=False).withColumn("created_at", F.lit(1))
    second = _investigations(spark, sf_dir, labelled=True).withColumn("created_at", F.lit(2))
    return incident.latest_per_run(first.unionByName(second))


def investigation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = incident.trace_steps(newest_trace(spark, sf_dir))
    content = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("content")), lambda e: F.concat_ws("=", e["key"], e["value"])
        ),
        "; ",
    )
    return steps.select(
        "file_id", F.col("seq").cast("long").alias("seq"), "agent", "action", content.alias("content")
    )


def report_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Completed runs with their file names, and their groups."""
    runs = serving.completed_runs(inputs.runs(spark, sf_dir))
    groups = inputs.enriched_groups(spark, sf_dir).join(runs.select("file_id"), "file_id", "left_semi")
    return runs.join(inputs.files(spark, sf_dir), "file_id"), groups


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = report.incident_reports(*report_inputs(spark, sf_dir), GENERATED_AT, fixed.REPORT_SAMPLE_LINES, fixed.REPORT_TIP_GROUPS)
    return reports.select("report_id", "file_id", "title", "markdown")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "incident_timeline": incident_timeline,
    "investigation": investigation,
    "investigation_trace": investigation_trace,
    "incident_reports": incident_reports,
}
