"""Error grouping: lines to templates to counted groups, and run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import fingerprint, in_list, severity_of_level, template_of
from logspark.operators.scale import cut

IDENTITY = ["file_id", "level", "template"]  # equivalent to (file_id, fingerprint)


def templated(parsed: DataFrame, rule_set: str = "compat") -> DataFrame:
    """Add the template of lines that count as errors; other lines get null."""
    grouped = in_list(F.col("level"), fixed.GROUPED_LEVELS)
    return parsed.withColumn("template", F.when(grouped, template_of(F.col("message"), rule_set)))


def error_lines(parsed: DataFrame, rule_set: str = "compat") -> DataFrame:
    """Lines of the grouped levels with their template; the filter comes first."""
    kept = parsed.filter(in_list(F.col("level"), fixed.GROUPED_LEVELS))
    return kept.select(
        "file_id",
        "level",
        template_of(F.col("message"), rule_set).alias("template"),
        "line_no",
        "ts",
        "text",
    )


def group_counts(errors: DataFrame) -> DataFrame:
    """Count and time range per group.

    Grouping by level and template instead of by their hash keeps string values
    out of the aggregation buffer, so Spark uses a hash aggregate with partial
    sums, and the hash is computed once per group instead of once per line.
    """
    return errors.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def group_samples(errors: DataFrame, k: int = fixed.SAMPLES_PER_GROUP) -> DataFrame:
    """The first ``k`` lines of each group in file order.

    The rank filter becomes a group limit that runs before the shuffle, so a
    group sends at most ``k`` rows per task however many lines it has.
    """
    order = Window.partitionBy(*IDENTITY).orderBy("line_no")
    first = (
        errors.select(*IDENTITY, "line_no", "text")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
    )
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return first.groupBy(*IDENTITY).agg(F.transform(ordered, lambda s: s["text"]).alias("sample_lines"))


def groups_of(errors: DataFrame) -> DataFrame:
    """One row per file and fingerprint with count, times, severity and samples.

    Both branches are partitioned by the group identity, so joining them adds
    no shuffle.
    """
    joined = group_counts(errors).join(group_samples(errors), IDENTITY)
    return joined.select(
        "file_id",
        fingerprint(F.col("level"), F.col("template")).alias("fingerprint"),
        "level",
        "template",
        severity_of_level(F.col("level")).alias("severity"),
        "count",
        "first_seen",
        "last_seen",
        "sample_lines",
    )


def error_groups(parsed: DataFrame, rule_set: str = "compat") -> DataFrame:
    """Groups of a parsed line table.

    Parsing and templating cost far more than a write, so the error lines are
    stored once and read by both the counts and the samples.
    """
    return groups_of(cut(error_lines(parsed, rule_set), "error_lines"))


def run_counters(parsed: DataFrame, rule_set: str = "compat") -> DataFrame:
    """Per file: lines, parsed lines, error lines and distinct groups.

    Lines are first reduced to one row per file and template, and only those
    rows are reduced to files, so no file is counted in a single task.
    """
    in_group = F.col("template").isNotNull()
    grouped_level = F.when(in_group, F.col("level")).alias("level")
    reduced = (
        templated(parsed, rule_set)
        .groupBy("file_id", grouped_level, "template")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if("parsed").alias("parsed"))
    )
    return reduced.groupBy("file_id").agg(
        F.sum("lines").alias("total_lines"),
        F.sum("parsed").alias("parsed_lines"),
        F.coalesce(F.sum(F.when(in_group, F.col("lines"))), F.lit(0)).alias("error_lines"),
        F.count_if(in_group).alias("group_count"),
    )


def severity_breakdown(groups: DataFrame, runs: DataFrame, run: str = "file_id") -> DataFrame:
    """Groups per severity and run, as text such as ``1 critical, 2 high``."""
    counts = groups.groupBy(run, "severity").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("severity", "n")))
    shown = F.array_join(
        F.transform(parts, lambda p: F.concat_ws(" ", p["n"].cast("string"), p["severity"])), ", "
    )
    spread = counts.groupBy(run).agg(shown.alias("severity_spread"))
    return runs.select(run).join(spread, run, "left").select(
        run, F.coalesce("severity_spread", F.lit("none")).alias("severity_spread")
    )
