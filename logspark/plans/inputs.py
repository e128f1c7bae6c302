"""Input tables of the registered queries, derived by Spark from the given tables.

The service this models keeps what it ingests: line tables, groups, insights
and request logs are stored once and read by every later question.  Here they
are written once per application and data folder to the shared folder, so each
query starts from stored tables with pruning and pushdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import enrichment, grouping, parsing
from logspark.operators.scale import cut, new_path, number_rows

SYSLOG_YEAR = 2024
TENANTS = 5

_STORED: dict[tuple[str, str, str], DataFrame] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """The stored table ``name`` for this data folder, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = cut(build(spark, sf_dir), name)
    return _STORED[key]


def stored_path(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder ``name`` for this data folder, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        path = new_path(spark, name)
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant instead of a zoneless time, and the number in ``props``."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _build_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file per user, one line per event, in one of four formats."""
    user, k, event = (F.col(c).cast("string") for c in ("user_id", "k", "event_id"))
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    level = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "warning")
        .when(F.col("event_type") == "signup", "critical")
        .when(F.col("event_type") == "view", "info")
        .otherwise("debug")
    )
    kind = F.col("k") % 6
    host = (F.col("user_id") % 250).cast("string")
    message = (
        F.when(kind == 0, F.concat(F.lit("Database connection timeout for user "), user, F.lit(" after "), amount, F.lit(" ms")))
        .when(kind == 1, F.concat(F.lit("Redis connection pool exhausted at 10.0."), k, F.lit("."), host, F.lit(":6379")))
        .when(kind == 2, F.concat(F.lit("Out of memory, killing worker "), event))
        .when(kind == 3, F.concat(F.lit("Slow query took "), amount, F.lit(" ms reading 'chunk "), k, F.lit("'")))
        .when(kind == 4, F.concat(F.lit("Upstream returned HTTP 502 for request "), F.md5(event.cast("binary"))))
        .otherwise(F.concat(F.lit("Disk quota exceeded on /var/data/vol"), k, F.lit("/seg.bin")))
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    lvl, msg = F.col("lvl"), F.col("msg")
    form = F.col("user_id") % 4
    raw = (
        F.when(form == 0, F.concat(F.lit('{"timestamp": "'), iso, F.lit('Z", "level": "'), lvl, F.lit('", "message": "'), msg, F.lit('"}')))
        .when(form == 1, F.concat(F.lit("time="), iso, F.lit("Z level="), lvl, F.lit(' msg="'), msg, F.lit('" service=api')))
        .when(form == 2, F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" web-1 app[221]: "), lvl, F.lit(" "), msg))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper(lvl), F.lit(" "), msg))
    )
    lines = (
        events(spark, sf_dir)
        .withColumn("lvl", level)
        .withColumn("msg", message)
        .select(F.col("user_id").alias("file_id"), "event_id", raw.alias("raw"))
    )
    return number_rows(lines, ["file_id"], ["event_id"], "line_no").select("file_id", "line_no", "raw")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "log_lines", _build_log_lines)


def _build_request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One served request per event."""
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    parts = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    ident = F.concat_ws("-", *parts)
    route = F.col("k") % 5
    path = (
        F.when(route == 0, F.concat(F.lit("/api/v1/analyses/"), ident))
        .when(route == 1, F.concat(F.lit("/api/v1/analyses/"), ident, F.lit("/groups")))
        .when(route == 2, F.concat(F.lit("/api/v1/logs/"), ident, F.lit("/chat")))
        .when(route == 3, F.lit("/api/v1/health"))
        .otherwise(F.lit("/metrics"))
    )
    kind = F.col("event_type")
    status = (
        F.when((kind == "error") & (F.col("k") % 2 == 0), 503)
        .when(kind == "error", 500)
        .when(F.col("k") % 10 == 9, 404)
        .when(kind == "purchase", 202)
        .otherwise(200)
    )
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.when(kind == "purchase", "POST").otherwise("GET").alias("method"),
        path.alias("path"),
        status.alias("status"),
        (F.col("value") / 1000).alias("duration_s"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("client_ip"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "request_log", _build_request_log)


def _build_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four long files made of order lines; equal lines are interchangeable."""
    flag = (
        F.when(F.col("l_returnflag") == "R", " ERROR ")
        .when(F.col("l_returnflag") == "A", " WARNING ")
        .otherwise(" INFO ")
    )
    raw = F.concat(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
        flag,
        F.lit("shipment of order "),
        F.col("l_orderkey").cast("string"),
        F.lit(" part "),
        F.col("l_partkey").cast("string"),
        F.lit(" delayed "),
        F.col("l_quantity").cast("int").cast("string"),
        F.lit(" h"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("file_id"),
        raw.alias("raw"),
        F.monotonically_increasing_id().alias("_copy"),
    )
    numbered = number_rows(lines, ["file_id"], ["raw", "_copy"], "line_no")
    return numbered.select("file_id", "line_no", "raw")


def long_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "long_log_lines", _build_long_lines)


def pasted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pasted files; the language stands in for the tenant."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("lang").alias("user_id"),
        F.concat(F.lit("paste-"), F.col("doc_id").cast("string"), F.lit(".log")).alias("filename"),
        F.col("text").alias("content"),
    )


# --- stored results of earlier steps --------------------------------------------------


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "formats", lambda s, d: parsing.detect_formats(log_lines(s, d)))


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines, detected and parsed once."""

    def build(s: SparkSession, d: str) -> DataFrame:
        return parsing.parse_lines(parsing.attach_formats(log_lines(s, d), formats(s, d)), SYSLOG_YEAR)

    return stored(spark, sf_dir, "parsed_lines", build)


def _build_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error groups with tenant, stable id and the format of their file."""
    groups = grouping.error_groups(parsed_lines(spark, sf_dir))
    natural_key = F.concat_ws("|", F.col("file_id").cast("string"), "fingerprint")
    return groups.join(formats(spark, sf_dir).select("file_id", "format"), "file_id").select(
        "*",
        (F.col("file_id") % TENANTS).alias("user_id"),
        F.sha2(natural_key, 256).alias("group_id"),
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "groups", _build_groups)


def _build_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis run per file; the last log time stands in for its creation."""
    parsed = parsed_lines(spark, sf_dir)
    created = parsed.groupBy("file_id").agg(F.max("ts").alias("created_at"))
    status = F.when(F.col("file_id") % 17 == 16, "failed").otherwise("completed")
    return grouping.run_counters(parsed).join(created, "file_id").select(
        "*", (F.col("file_id") % TENANTS).alias("user_id"), status.alias("status")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "runs", _build_runs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of the runs."""
    name = F.concat(F.lit("app-"), F.col("file_id").cast("string"), F.lit(".log"))
    return runs(spark, sf_dir).select("file_id", name.alias("filename"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "insights", lambda s, d: enrichment.enrich(groups(s, d))
    )


def enriched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their insight payload and refined severity."""
    return stored(
        spark,
        sf_dir,
        "enriched_groups",
        lambda s, d: enrichment.refine_severity(groups(s, d), insights(s, d)),
    )


QUESTIONS = [
    "why did the database time out?",
    "which worker ran out of memory?",
    "redis pool exhausted",
    "disk quota on which volume?",
    "upstream 502 errors",
    "certificate renewal of the ingress",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six questions about every file."""
    asked = F.posexplode(F.array(*[F.lit(x) for x in QUESTIONS])).alias("n", "question")
    return runs(spark, sf_dir).select("file_id", asked).select(
        (F.col("file_id") * len(QUESTIONS) + F.col("n")).alias("question_id"), "file_id", "question"
    )
