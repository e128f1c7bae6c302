"""Registered queries over raw lines: scan, detection, parsing, grouping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.text import fingerprint, parse_timestamp
from logspark.operators import grouping, parsing
from logspark.plans import inputs
from logspark.plans.inputs import SYSLOG_YEAR
from logspark.sources import lines as line_source
from logspark.sources import manifest


def shown_time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def line_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical and counted lines per pasted text; one row per text, no shuffle."""
    lines = line_source.text_lines(F.col("content"))
    counted = F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c")) != "")
    return inputs.pasted_texts(spark, sf_dir).select(
        "file_id",
        F.size(lines).cast("long").alias("physical_lines"),
        F.size(counted).cast("long").alias("total_lines"),
    )


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_of_texts(inputs.pasted_texts(spark, sf_dir)).drop("user_id")


def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.manifest_of_texts(inputs.pasted_texts(spark, sf_dir))
    flagged = manifest.flag_duplicates(rows)
    return flagged.select("file_id", "user_id", "copies", "first_file", "is_duplicate")


def timestamp_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in accepted and rejected shapes and read back."""
    micros = F.date_format("ts", "SSSSSS")
    spaced = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shapes = [
        F.concat(spaced, F.lit(","), F.substring(micros, 1, 3)),
        F.concat(spaced, F.lit("."), micros),
        F.concat(F.lit(" "), spaced),
        F.concat(iso, F.lit("."), micros, F.lit("+05:30")),
        F.concat(iso, F.lit("Z")),
        F.concat(iso, F.lit("-0330")),
        F.concat(iso, F.lit("."), F.substring(micros, 1, 2)),
        iso,
        F.concat(spaced, F.lit("+02:00")),
        F.concat(iso, F.lit(","), micros),
        F.unix_seconds("ts").cast("string"),
    ]
    shape = (F.col("event_id") % len(shapes)).cast("int")
    events = inputs.events(spark, sf_dir).select(
        "event_id", F.get(F.array(*shapes), shape).alias("text")
    )
    read = parse_timestamp(F.col("text"))
    return events.select("event_id", "text", F.unix_micros(read).alias("micros"))


def format_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.detect_formats(inputs.log_lines(spark, sf_dir))


def _parse_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = inputs.log_lines(spark, sf_dir)
        formats = parsing.detect_formats(lines)
        tagged = parsing.attach_formats(lines, formats).filter(F.col("format") == name)
        return parsing.parse_lines(tagged, SYSLOG_YEAR).select(
            "file_id", "line_no", "parsed", "level", shown_time("ts"), "message"
        )

    return run


def message_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = grouping.error_lines(inputs.parsed_lines(spark, sf_dir))
    counted = errors.groupBy("level", "template").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("fingerprint", fingerprint(F.col("level"), F.col("template")))


def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_groups(grouping.error_groups(inputs.parsed_lines(spark, sf_dir)))


def shown_groups(groups: DataFrame) -> DataFrame:
    return groups.select(
        "file_id",
        "fingerprint",
        "level",
        "template",
        "severity",
        "count",
        shown_time("first_seen"),
        shown_time("last_seen"),
        F.size("sample_lines").cast("long").alias("samples"),
        F.sha2(F.array_join("sample_lines", "\n"), 256).alias("samples_sha"),
    )


def long_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four long files: each holds a quarter of all lines."""
    parsed = parsing.parse_log(inputs.long_log_lines(spark, sf_dir), SYSLOG_YEAR)
    return grouping.error_groups(parsed).select(
        "file_id",
        "level",
        "template",
        "count",
        shown_time("first_seen"),
        shown_time("last_seen"),
        F.array_join("sample_lines", "\n").alias("sample_lines"),
    )


def group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = grouping.error_lines(inputs.parsed_lines(spark, sf_dir))
    return grouping.group_samples(errors).withColumn(
        "sample_lines", F.array_join("sample_lines", "\n")
    )


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.run_counters(inputs.parsed_lines(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "line_scan_counts": line_scan_counts,
    "file_manifest": file_manifest,
    "duplicate_uploads": duplicate_uploads,
    "timestamp_cascade": timestamp_cascade,
    "format_detection": format_detection,
    "parse_json_lines": _parse_query("json"),
    "parse_logfmt_lines": _parse_query("logfmt"),
    "parse_syslog_lines": _parse_query("syslog"),
    "parse_plain_lines": _parse_query("plain"),
    "message_templates": message_templates,
    "error_groups": error_groups,
    "long_file_groups": long_file_groups,
    "group_samples": group_samples,
    "run_counters": run_counters,
}
