"""Request metrics: counts, durations, rates, alerts and silent sources.

All windows are sums, so requests are first reduced to one row per series and
step; only those rows are copied into the windows that cover them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators.scale import number_rows

SERIES = ["method", "route"]


def route_template(path: Column) -> Column:
    """Collapse identifiers in a path, so that one route is one series.

    Two passes, because neighbouring segments share a slash.
    """
    mark = "/{id}$1"
    once = F.regexp_replace(path, F.lit(fixed.ROUTE_ID), F.lit(mark))
    return F.regexp_replace(once, F.lit(fixed.ROUTE_ID), F.lit(mark))


def measured(requests: DataFrame) -> DataFrame:
    """Requests with their route, without the scrape itself."""
    kept = requests.filter(F.col("path") != fixed.SCRAPE_PATH)
    return kept.withColumn("route", route_template(F.col("path")))


def _seconds() -> Column:
    """Durations as exact decimals, so sums do not depend on the order of addition."""
    return F.col("duration_s").cast("decimal(18,6)")


def request_counts(requests: DataFrame) -> DataFrame:
    return measured(requests).groupBy(*SERIES, "status").agg(F.count(F.lit(1)).alias("requests"))


def request_durations(requests: DataFrame) -> DataFrame:
    return measured(requests).groupBy(*SERIES).agg(
        F.sum(_seconds()).cast("decimal(24,6)").alias("duration_sum"),
        F.count(F.lit(1)).alias("duration_count"),
    )


def red_metrics(requests: DataFrame) -> DataFrame:
    """Requests, errors and durations per method and route in one pass."""
    return measured(requests).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum(_seconds()).cast("decimal(24,6)").alias("duration_sum"),
        F.max(_seconds()).alias("duration_max"),
    )


def total_requests(requests: DataFrame) -> DataFrame:
    return request_counts(requests).agg(F.sum("requests").alias("requests"))


def metrics_text(requests: DataFrame) -> DataFrame:
    """The text exposition as lines; sort by ``section, method, route, status``.

    The number of lines is the number of series, not of requests.
    """
    counts = request_counts(requests)
    durations = request_durations(requests)

    def lines(rows: DataFrame, section: int, name: str, shown: Column) -> DataFrame:
        status = F.col("status") if "status" in rows.columns else F.lit(None).cast("int")
        return rows.select(
            F.lit(section).alias("section"), "method", "route", status.alias("status"), shown.alias("line")
        )

    names = list(fixed.METRIC_HELP)
    spark = requests.sparkSession
    heads = spark.createDataFrame(
        [
            (i, "", kind, None, line)
            for i, name in enumerate(names)
            for kind, line in (
                ("0", f"# HELP {name} {fixed.METRIC_HELP[name]}"),
                ("1", f"# TYPE {name} counter"),
            )
        ],
        "section int, method string, route string, status int, line string",
    )
    labels = 'method="%s",path="%s"'
    return (
        heads.unionByName(
            lines(
                counts,
                0,
                names[0],
                F.format_string(
                    names[0] + "{" + labels + ',status="%d"} %d', *SERIES, "status", "requests"
                ),
            )
        )
        .unionByName(
            lines(
                durations,
                1,
                names[1],
                F.format_string(
                    names[1] + "{" + labels + "} %s", *SERIES, F.col("duration_sum").cast("string")
                ),
            )
        )
        .unionByName(
            lines(
                durations,
                2,
                names[2],
                F.format_string(names[2] + "{" + labels + "} %d", *SERIES, "duration_count"),
            )
        )
    )


# --- sliding windows ----------------------------------------------------------------


def stepped(requests: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """Sums per key and step of time: the only place that touches every request."""
    step = F.floor(F.unix_seconds("ts") / step_s).cast("long")
    return measured(requests).groupBy(*keys, step.alias("step")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.sum(_seconds()).alias("seconds"),
    )


def sliding(steps: DataFrame, keys: list[str], window_s: int, step_s: int) -> DataFrame:
    """Sums over the window that ends with each step; ``window_s`` is a multiple of ``step_s``.

    ``end_s`` is the end of the window in epoch seconds.
    """
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    covering = F.explode(F.sequence(F.col("step") + 1, F.col("step") + window_s // step_s))
    spread = steps.select(*keys, covering.alias("_end"), "requests", "errors", "seconds")
    end_s = (F.col("_end") * step_s).alias("end_s")
    return spread.groupBy(*keys, end_s).agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.sum("seconds").alias("seconds"),
    )


def request_rate(requests: DataFrame, window_s: int = 300, step_s: int = 60) -> DataFrame:
    """Requests per second by route over a sliding window."""
    keys = ["route"]
    sums = sliding(stepped(requests, keys, step_s), keys, window_s, step_s)
    return sums.select(
        "route", "end_s", "requests", (F.col("requests") / window_s).alias("rate")
    )


# --- alerts --------------------------------------------------------------------------


def sustained(
    evaluations: DataFrame, keys: list[str], condition: Column, step_s: int, hold_s: int
) -> DataFrame:
    """Intervals in which a condition held at every step for at least ``hold_s``.

    ``evaluations`` has one row per key and ``end_s``, a multiple of ``step_s`` apart.
    Rows are numbered by ranges, so one long series is spread over many tasks.
    """
    held = number_rows(evaluations.filter(condition), keys, ["end_s"], "_n")
    # Steps without a gap keep the same distance from their number.
    islands = held.withColumn("_island", F.floor(F.col("end_s") / step_s) - F.col("_n"))
    spans = islands.groupBy(*keys, "_island").agg(
        F.min("end_s").alias("pending_s"), F.max("end_s").alias("until_s"), F.max("value").alias("peak")
    )
    return (
        spans.filter(F.col("until_s") - F.col("pending_s") >= hold_s)
        .withColumn("firing_s", F.col("pending_s") + hold_s)
        .select(*keys, "pending_s", "firing_s", "until_s", "peak")
    )


def error_ratio(sums: DataFrame) -> DataFrame:
    return sums.withColumn("value", F.col("errors") / F.col("requests"))


def mean_latency(sums: DataFrame) -> DataFrame:
    return sums.withColumn("value", F.col("seconds").cast("double") / F.col("requests"))


def error_ratio_alerts(
    requests: DataFrame,
    window_s: int = 300,
    step_s: int = 60,
    hold_s: int = 300,
    limit: float = fixed.ERROR_RATIO_LIMIT,
    keys: list[str] | None = None,
) -> DataFrame:
    """Intervals in which the share of 5xx answers stayed above the limit."""
    keys = keys or []
    values = error_ratio(sliding(stepped(requests, keys, step_s), keys, window_s, step_s))
    return sustained(values, keys, F.col("value") > limit, step_s, hold_s)


def latency_alerts(
    requests: DataFrame,
    window_s: int = 300,
    step_s: int = 60,
    hold_s: int = 600,
    limit: float = fixed.LATENCY_LIMIT_SECONDS,
    keys: list[str] | None = None,
) -> DataFrame:
    """Intervals in which the mean duration stayed above the limit."""
    keys = keys or []
    values = mean_latency(sliding(stepped(requests, keys, step_s), keys, window_s, step_s))
    return sustained(values, keys, F.col("value") > limit, step_s, hold_s)


def down_gaps(
    requests: DataFrame, source: str, hold_s: int = 60, as_of: datetime | None = None
) -> DataFrame:
    """Silences longer than ``hold_s`` between consecutive signs of life of a source.

    With ``as_of`` a source that has been silent since then is down as well; its
    ``back_us`` is null and the silence counts up to ``as_of``.

    Rows are reduced to first and last time per source and bucket of ``hold_s``.
    Within a bucket no silence can exceed ``hold_s``, so comparing neighbouring
    buckets finds every gap, and a busy source has one row per bucket.
    """
    seen = F.unix_micros("ts")
    bucket = F.floor(seen / (hold_s * 1_000_000)).cast("long")
    buckets = requests.groupBy(source, bucket.alias("_bucket")).agg(
        F.min(seen).alias("_first"), F.max(seen).alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(source).orderBy("_bucket"))
    gaps = buckets.select(
        source, before.alias("last_seen_us"), F.col("_first").alias("back_us"), F.col("_first").alias("_until")
    )
    if as_of is not None:
        now = F.unix_micros(F.lit(as_of).cast("timestamp"))
        silent = requests.groupBy(source).agg(F.max(seen).alias("last_seen_us"))
        open_ended = silent.select(source, "last_seen_us", F.lit(None).cast("long").alias("back_us"), now.alias("_until"))
        gaps = gaps.unionByName(open_ended)
    silence = F.col("_until") - F.col("last_seen_us")
    return gaps.filter(silence > hold_s * 1_000_000).select(
        source, "last_seen_us", "back_us", (silence / 1_000_000).alias("gap_s")
    )
