"""Registered queries over the request log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.text import strip
from logspark.operators import ratelimit, telemetry
from logspark.plans import inputs

HOUR, DAY = 3600, 86400
LATENCY_LIMIT = 0.02  # the given durations are far below the default limit


def red_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.red_metrics(inputs.request_log(spark, sf_dir))
    return rows.select(
        "method", "route", "requests", "errors",
        F.col("duration_sum").cast("string").alias("duration_sum"),
        F.col("duration_max").cast("string").alias("duration_max"),
    )


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.metrics_text(inputs.request_log(spark, sf_dir)).select("section", "line")


def total_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.total_requests(inputs.request_log(spark, sf_dir))


def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.request_rate(inputs.request_log(spark, sf_dir), window_s=6 * HOUR, step_s=HOUR)
    return rows.withColumn("rate", F.round("rate", 6))


def _rounded(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("peak", F.round("peak", 6))


def error_ratio_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per route, over six hours, held for three hours."""
    return _rounded(
        telemetry.error_ratio_alerts(
            inputs.request_log(spark, sf_dir), 6 * HOUR, HOUR, 3 * HOUR, limit=0.25, keys=["route"]
        )
    )


def latency_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per route, over six hours, held for four hours."""
    return _rounded(
        telemetry.latency_alerts(
            inputs.request_log(spark, sf_dir), 6 * HOUR, HOUR, 4 * HOUR, LATENCY_LIMIT, keys=["route"]
        )
    )


def service_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error ratio of the whole service, as one series."""
    return _rounded(
        telemetry.error_ratio_alerts(
            inputs.request_log(spark, sf_dir), 6 * HOUR, HOUR, 6 * HOUR, limit=0.2
        )
    )


def down_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that were silent for more than two days, up to the last request of any client."""
    requests = inputs.request_log(spark, sf_dir)
    now = requests.agg(F.max("ts")).first()[0]
    rows = telemetry.down_gaps(requests, "client_ip", 2 * DAY, as_of=now)
    return rows.withColumn("gap_s", F.round("gap_s", 3))


RATE_TIMES, RATE_SECONDS = 2, 3 * DAY


def rate_limited_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits in three days per path and client."""
    return ratelimit.admitted_hits(inputs.request_log(spark, sf_dir), RATE_TIMES, RATE_SECONDS)


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route templates of page addresses: many paths, few routes."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    route = telemetry.route_template(strip(path))
    pages = inputs.table(spark, sf_dir, "pages").select(route.alias("route"))
    return pages.groupBy("route").agg(F.count(F.lit(1)).alias("pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "red_metrics": red_metrics,
    "metrics_text": metrics_text,
    "total_requests": total_requests,
    "request_rate": request_rate,
    "error_ratio_alerts": error_ratio_alerts,
    "latency_alerts": latency_alerts,
    "service_alerts": service_alerts,
    "down_gaps": down_gaps,
    "rate_limited_hits": rate_limited_hits,
    "page_routes": page_routes,
}
