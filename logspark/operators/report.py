"""Markdown incident reports, built as ordered parts and joined per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import severity_rank
from logspark.operators.commands import with_command_list
from logspark.operators.enrichment import top_groups
from logspark.operators.grouping import severity_breakdown
from logspark.operators.scale import number_rows

RUN = "file_id"
_HEADER, _FINDINGS, _PREVENTION = 0, 1, 2
_PARTS_PER_BLOCK = 256


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _thousands(name: str) -> Column:
    return F.format_number(name, 0)


def _ranked(groups: DataFrame) -> DataFrame:
    """Number the groups of a run by frequency without ordering a run in one task."""
    keyed = groups.withColumn("_order", -F.col("count"))
    return number_rows(keyed, [RUN], ["_order", "fingerprint"], "rank").drop("_order")


def report_titles(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """Title from the worst severity of a run and its file name."""
    worst = groups.groupBy(RUN).agg(F.min(severity_rank(F.col("severity"))).alias("_worst"))
    names = F.array(*[F.lit(s) for s in fixed.SEVERITIES])
    severity = F.initcap(F.get(names, F.col("_worst")))
    title = F.when(
        F.col("_worst").isNull(), F.format_string(fixed.REPORT_TITLE_CLEAN, "filename")
    ).otherwise(F.format_string(fixed.REPORT_TITLE, severity, "filename"))
    return runs.join(worst, RUN, "left").withColumn("title", title).drop("_worst")


def _summary() -> Column:
    return (
        F.when(F.col("_top").isNull(), F.lit(fixed.REPORT_SUMMARY_CLEAN))
        .when(
            F.col("_top.payload").isNotNull(),
            F.format_string(
                fixed.REPORT_SUMMARY_INSIGHT,
                "_top.payload.error_type",
                "_top.count",
                "_top.payload.root_cause",
            ),
        )
        .otherwise(F.format_string(fixed.REPORT_SUMMARY_TEMPLATE, "_top.count", "_top.template"))
    )


def _header(titled: DataFrame, groups: DataFrame, generated_at: str) -> DataFrame:
    top = top_groups(groups, 1).select(RUN, F.struct("count", "template", "payload").alias("_top"))
    spread = severity_breakdown(groups, titled)
    text = _lines(
        F.concat(F.lit("# "), F.col("title")),
        "",
        F.format_string(
            fixed.REPORT_GENERATED,
            F.lit(generated_at),
            "filename",
            _thousands("total_lines"),
            _thousands("error_lines"),
            "group_count",
        ),
        "",
        "## Summary",
        "",
        _summary(),
        "",
        "## Impact",
        "",
        F.format_string(fixed.REPORT_IMPACT, _thousands("error_lines"), "group_count"),
        F.format_string(fixed.REPORT_SPREAD, "severity_spread"),
        "",
        "## Findings",
        "",
    )
    joined = titled.join(top, RUN, "left").join(spread, RUN)
    return joined.select(
        RUN, F.lit(_HEADER).alias("section"), F.lit(0).cast("long").alias("seq"), text.alias("text")
    )


def _findings(ranked: DataFrame, sample_lines: int | None) -> DataFrame:
    p = F.col("payload")
    typed = with_command_list(ranked.withColumn("error_type", p["error_type"]))
    heading = F.format_string(
        fixed.REPORT_FINDING, "rank", F.coalesce("error_type", "template"), "severity", "count"
    )
    shown = F.transform("commands", lambda c: F.concat(c["command"], F.lit("  # "), c["description"]))
    commands = F.when(
        F.size("commands") > 0,
        _lines(fixed.REPORT_COMMANDS, "", "```bash", F.array_join(shown, "\n"), "```", ""),
    )
    insight = _lines(
        F.format_string(fixed.REPORT_CAUSE, p["root_cause"]),
        "",
        F.format_string(fixed.REPORT_EXPLANATION, p["explanation"]),
        "",
        F.format_string(fixed.REPORT_FIX, p["suggested_fix"]),
        "",
        commands,
    )
    shown_lines = F.col("sample_lines") if sample_lines is None else F.slice("sample_lines", 1, sample_lines)
    samples = F.when(
        F.size("sample_lines") > 0,
        _lines(
            fixed.REPORT_SAMPLES_OPEN,
            "",
            "```",
            F.array_join(shown_lines, "\n"),
            "```",
            "",
            fixed.REPORT_SAMPLES_CLOSE,
            "",
        ),
    )
    body = F.when(p.isNull(), _lines(fixed.REPORT_NO_INSIGHT, "")).otherwise(insight)
    return typed.select(
        RUN,
        F.lit(_FINDINGS).alias("section"),
        F.col("rank").alias("seq"),
        _lines(heading, "", body, samples).alias("text"),
    )


def _prevention(titled: DataFrame, groups: DataFrame, tip_groups: int | None) -> DataFrame:
    tip = F.format_string(fixed.REPORT_TIP, "payload.error_type", "payload.suggested_fix")
    entry = F.struct("group_rank", tip.alias("tip"))
    tips = (
        top_groups(groups, tip_groups)
        .filter(F.col("payload").isNotNull())
        .groupBy(RUN)
        .agg(F.array_sort(F.collect_list(entry)).alias("_tips"))
    )
    listed = F.array_join(F.transform("_tips", lambda t: t["tip"]), "\n")
    text = _lines("## Prevention", "", F.coalesce(listed, F.lit(fixed.REPORT_TIP_DEFAULT)), "")
    return titled.select(RUN).join(tips, RUN, "left").select(
        RUN, F.lit(_PREVENTION).alias("section"), F.lit(0).cast("long").alias("seq"), text.alias("text")
    )


def report_parts(
    runs: DataFrame,
    groups: DataFrame,
    generated_at: str,
    sample_lines: int | None = None,
    tip_groups: int | None = None,
) -> DataFrame:
    """Ordered text parts ``file_id, section, seq, text`` of every report.

    All sample lines of a group are shown, or the first ``sample_lines``; tips come from all groups
    of a run, or the ``tip_groups`` largest.

    ``runs`` has ``file_id, filename, total_lines, error_lines, group_count`` and
    ``groups`` carries ``payload`` or null and the refined severity.
    """
    titled = report_titles(runs, groups)
    return (
        _header(titled, groups, generated_at)
        .unionByName(_findings(_ranked(groups), sample_lines))
        .unionByName(_prevention(titled, groups, tip_groups))
    )


def assemble(parts: DataFrame) -> DataFrame:
    """Join the parts of a run into one text, block by block.

    One report is one string value; a run with more findings than a string can
    hold is exported from its parts instead (``sinks.write_report_files``).
    """
    block = F.floor(F.col("seq") / _PARTS_PER_BLOCK).cast("long")

    def joined(order: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
        return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")

    blocks = parts.groupBy(RUN, "section", block.alias("_block")).agg(joined("seq"))
    order = F.struct("section", "_block").alias("_order")
    keyed = blocks.select(RUN, order, "text")
    return keyed.groupBy(RUN).agg(joined("_order")).withColumnRenamed("text", "markdown")


def incident_reports(
    runs: DataFrame,
    groups: DataFrame,
    generated_at: str,
    sample_lines: int | None = None,
    tip_groups: int | None = None,
) -> DataFrame:
    """One report per run; the id depends on the run only, so regenerating keeps it."""
    documents = assemble(report_parts(runs, groups, generated_at, sample_lines, tip_groups))
    titles = report_titles(runs, groups).select(RUN, "title")
    report_id = F.sha2(F.concat(F.lit("report|"), F.col(RUN).cast("string")), 256)
    return titles.join(documents, RUN).select(
        report_id.alias("report_id"), RUN, "title", "markdown"
    )
