"""Registered queries over readers and sinks: what was written, written again by a replay, and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators import incident, report, retrieval, serving, telemetry
from logspark.operators.scale import new_path
from logspark.plans import inputs
from logspark.plans.incident_queries import GENERATED_AT, newest_trace, report_inputs
from logspark.sources import line_ranges
from logspark.sources import lines as line_source
from logspark.sources import manifest, sinks


def _written_logs(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as text files, one folder per log."""
    path = new_path(spark, "log-files")
    sinks.write_text_folders(inputs.log_lines(spark, sf_dir), path, "file_id", ["line_no"], "raw")
    return path


def _shown_lines(lines: DataFrame) -> DataFrame:
    number = F.regexp_extract("file_id", r"file_id=(\d+)/", 1).cast("long")
    return lines.select(number.alias("file_id"), "line_no", F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


def read_large_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read in splits and numbered."""
    return _shown_lines(line_source.read_large_files(spark, _written_logs(spark, sf_dir)))


def read_small_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read whole."""
    return _shown_lines(line_source.read_small_files(spark, _written_logs(spark, sf_dir)))


def cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty lines after a quarter of the longest file, found through the line index."""
    folder, index = new_path(spark, "long-files"), new_path(spark, "line-index")
    lines = inputs.long_log_lines(spark, sf_dir)
    sinks.write_text_folders(lines, folder, "file_id", ["line_no"], "raw", long_files=True)
    line_ranges.write_line_index(spark, folder, index)
    longest = lines.groupBy("file_id").agg(F.max("line_no").alias("n")).orderBy(F.desc("n"), "file_id").first()
    path = spark.read.format("binaryFile").load(f"{folder}/file_id={longest['file_id']}").select("path").first()["path"]
    first = longest["n"] // 4 + 1
    return _shown_lines(line_ranges.read_lines(spark, index, path, first, first + 39))


def _stored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of even and odd files as two batches; the first is delivered twice."""
    path = new_path(spark, "ingested")
    groups = inputs.groups(spark, sf_dir).select("group_id", "user_id", "file_id", "level", "count")
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        sinks.write_batch(groups.filter(F.col("file_id") % 2 == rest), path, batch)
    return sinks.read_batches(spark, path)


def ingested_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored_groups(spark, sf_dir)
    return stored.select("group_id", F.col("user_id").cast("long").alias("user_id"), "file_id", "level", "count")


def tenant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's groups; other tenants' folders are not read."""
    mine = serving.of_tenant(_stored_groups(spark, sf_dir), 3)
    return mine.select("group_id", "file_id", "level", "count")


def versioned_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by level, replaced by a version with the refined ones; version 2 is written twice."""
    path = new_path(spark, "versions")
    sinks.write_version(inputs.groups(spark, sf_dir).select("group_id", "severity"), path, 1)
    refined = inputs.enriched_groups(spark, sf_dir).select("group_id", "severity")
    for _ in range(2):
        newest = sinks.write_version(refined, path, 2)
    return spark.read.parquet(newest)


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report parts written as files and put together again."""
    path = new_path(spark, "reports")
    runs, groups = report_inputs(spark, sf_dir)
    sinks.write_report_files(runs, groups, GENERATED_AT, path, fixed.REPORT_SAMPLE_LINES, fixed.REPORT_TIP_GROUPS)
    whole = report.assemble(sinks.read_report_files(spark, path))
    return whole.select("file_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def exported_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as Markdown files, read back; the text ends with a line end as files do."""
    path = new_path(spark, "markdown")
    runs, groups = report_inputs(spark, sf_dir)
    parts = report.report_parts(runs, groups, GENERATED_AT, fixed.REPORT_SAMPLE_LINES, fixed.REPORT_TIP_GROUPS)
    sinks.write_report_markdown(parts, path)
    stored = sinks.read_report_markdown(spark, path)
    return stored.select(F.col("file_id").cast("long").alias("file_id"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def uploaded_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the log files as uploads, two empty ones among them."""
    path = _written_logs(spark, sf_dir)
    for number in (-1, -2):
        spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{path}/file_id={number}")
    rows = manifest.manifest_of_files(spark, path, "7")
    number = F.regexp_extract("file_id", r"file_id=(-?[0-9]+)/", 1).cast("long")
    return rows.select(number.alias("file_id"), "suffix", "size_bytes", "content_hash", "source", "reason")


def stored_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigation steps, their batch delivered twice."""
    path = new_path(spark, "trace")
    steps = incident.trace_steps(newest_trace(spark, sf_dir)).select("file_id", "seq", "agent", "action", "content")
    for _ in range(2):
        sinks.write_trace(steps, path, "one")
    stored = spark.read.parquet(path)
    return stored.select("file_id", F.col("seq").cast("long").alias("seq"), "agent", "action", F.size("content").cast("long").alias("entries"))


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer turns, their batch delivered twice."""
    path = new_path(spark, "messages")
    lines, questions = inputs.log_lines(spark, sf_dir), inputs.questions(spark, sf_dir)
    shapes, windowed = retrieval.asked_windows(lines, questions)
    answers = retrieval.answers(windowed, retrieval.retrieve(windowed, shapes, questions), questions)
    for _ in range(2):
        sinks.append_messages(answers, path, "one")
    stored = spark.read.parquet(path)
    return stored.select("question_id", F.col("turn").cast("long").alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exposition written as text and read back."""
    path = new_path(spark, "metrics")
    sinks.write_metrics_text(telemetry.metrics_text(inputs.request_log(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_large_logs": read_large_logs,
    "read_small_logs": read_small_logs,
    "cited_lines": cited_lines,
    "ingested_batches": ingested_batches,
    "tenant_groups": tenant_groups,
    "versioned_severities": versioned_severities,
    "stored_reports": stored_reports,
    "exported_reports": exported_reports,
    "uploaded_manifest": uploaded_manifest,
    "stored_trace": stored_trace,
    "stored_messages": stored_messages,
    "metrics_file": metrics_file,
}
