"""Incident views over groups: timeline, first failure, causal check, trace."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import severity_rank
from logspark.operators.scale import join_to_many

RUN = "file_id"


def timeline_order() -> list[Column]:
    """Dated first by time, then worst severity, then most frequent, then fingerprint."""
    return [
        F.col("first_seen").asc_nulls_last(),
        severity_rank(F.col("severity")).asc(),
        F.col("count").desc(),
        F.col("fingerprint").asc(),
    ]


def timeline(groups: DataFrame) -> DataFrame:
    """Events of all runs with exactly one first failure per run.

    ``groups`` carries ``payload`` or null.  The first event is found by a rank
    filter, which is cut to one row per task and run before the shuffle, and is
    joined back, so a run with many groups is never ordered in one task.  Order
    the result by run and ``timeline_order()`` when order matters.
    """
    label = F.coalesce(F.nullif(F.col("payload.error_type"), F.lit("")), F.col("template"))
    events = groups.select(
        RUN, "group_id", "fingerprint", label.alias("label"), "severity", "count", "first_seen", "last_seen"
    )
    first = first_events(events, 1).select(RUN, F.col("group_id").alias("_first"))
    joined = join_to_many(events, first, [RUN], "group_id", "first_failures")
    return joined.withColumn("is_first_failure", F.col("_first") == F.col("group_id")).drop("_first")


def first_events(events: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` events of every run with their position, or all of them."""
    order = Window.partitionBy(RUN).orderBy(*timeline_order())
    placed = events.withColumn("pos", F.row_number().over(order))
    return placed if n is None else placed.filter(F.col("pos") <= n)


def investigate(
    runs: DataFrame,
    events: DataFrame,
    require_dated: bool = False,
    subjects: int | None = None,
    downstream_labels: int | None = None,
) -> DataFrame:
    """One causal check per run: plan, findings, hypothesis, verdict, conclusion.

    The plan covers all events of a run, or its first ``subjects``; the findings name all
    later events of the plan, or the first ``downstream_labels``.  A limit keeps a run's row small and lets a rank
    filter prune before the shuffle.  ``runs`` also lists runs without events.
    """
    totals = events.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("first_seen").isNotNull()).alias("dated"),
    )
    entry = F.struct("pos", "label", F.col("count").alias("n"))
    lead = (
        first_events(events, subjects)
        .groupBy(RUN)
        .agg(F.array_sort(F.collect_list(entry)).alias("lead"))
    )
    evidence = runs.select(RUN).join(totals, RUN, "left").join(lead, RUN, "left")
    evidence = evidence.select(
        RUN,
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("dated", F.lit(0)).alias("dated"),
        F.transform("lead", lambda e: e["label"]).alias("_labels"),
        F.col("lead")[0]["n"].alias("_first_count"),
    )
    labels = F.coalesce("_labels", F.array().cast("array<string>"))
    first = F.get("_labels", F.lit(0))
    downstream = F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1)) if downstream_labels is None else F.lit(downstream_labels))
    has_first, cascade = F.col("event_count") > 0, F.col("event_count") > 1
    supported = has_first & (F.col("dated") > 0 if require_dated else F.lit(True))
    findings = F.array_compact(
        F.array(
            F.when(has_first, F.format_string(fixed.FIRST_FAILURE_FINDING, first, "_first_count")),
            F.when(
                cascade,
                F.format_string(
                    fixed.DOWNSTREAM_FINDING, F.array_join(downstream, fixed.DOWNSTREAM_ARROW)
                ),
            ),
        )
    )
    hypothesis = (
        F.when(~has_first, F.lit(fixed.NO_ORDERING))
        .when(cascade, F.format_string(fixed.TRIGGER_HYPOTHESIS, first))
        .otherwise(F.format_string(fixed.ISOLATED_HYPOTHESIS, first))
    )
    verified = supported & cascade
    checked = evidence.select(
        RUN,
        "event_count",
        labels.alias("plan"),
        findings.alias("findings"),
        hypothesis.alias("hypothesis"),
        verified.alias("verified"),
        F.when(verified, fixed.CONFIDENCE_VERIFIED)
        .when(has_first, fixed.CONFIDENCE_FIRST_FAILURE)
        .otherwise(fixed.CONFIDENCE_NONE)
        .alias("confidence"),
        F.when(verified, fixed.NOTE_VERIFIED).otherwise(fixed.NOTE_UNVERIFIED).alias("note"),
    )
    return checked.withColumn("conclusion", F.concat_ws(" ", "hypothesis", "note"))


class Step(NamedTuple):
    """One step of a trace: who did what, and its content from an investigation's columns."""

    agent: str
    action: str
    content: Callable[[], dict[str, Column]]


STEPS = [
    Step("planner", "plan", lambda: {"questions": F.to_json("plan"), "event_count": F.col("event_count")}),
    Step(
        "investigator",
        "hypothesis",
        lambda: {"hypothesis": F.col("hypothesis"), "findings": F.to_json("findings")},
    ),
    Step(
        "verifier",
        "verify",
        lambda: {"verified": F.col("verified"), "confidence": F.col("confidence"), "note": F.col("note")},
    ),
]


def trace_steps(
    investigations: DataFrame, steps: list[Step] = STEPS, max_steps: int | None = None
) -> DataFrame:
    """Ordered steps of every investigation, exploded with a zero-based ``seq``.

    A further step is a further entry of ``steps``; ``max_steps`` keeps the first ones.
    """

    def shown(step: Step) -> Column:
        pairs = [x for name, value in step.content().items() for x in (F.lit(name), value.cast("string"))]
        return F.struct(
            F.lit(step.agent).alias("agent"), F.lit(step.action).alias("action"), F.create_map(*pairs).alias("content")
        )

    kept = F.array(*[shown(step) for step in steps[:max_steps]])
    exploded = investigations.select("*", F.posexplode(kept).alias("seq", "_step"))
    return exploded.select(*investigations.columns, "seq", "_step.agent", "_step.action", "_step.content")


def latest_per_run(investigations: DataFrame, version: str = "created_at") -> DataFrame:
    """The newest investigation of every run; equal versions go by a hash of their content."""
    order = Window.partitionBy(RUN).orderBy(F.desc(version), F.desc(F.xxhash64(F.to_json(F.struct("*")))))
    ranked = investigations.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")
