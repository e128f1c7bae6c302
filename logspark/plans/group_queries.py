"""Registered queries over stored groups: pages, enrichment, commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.guards import filter_commands
from logspark.operators import commands, enrichment, grouping, serving
from logspark.operators.scale import new_path
from logspark.plans import inputs
from logspark.plans.ingest_queries import shown_time
from logspark.sources import insight_cache as stored_cache


def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.severity_breakdown(inputs.groups(spark, sf_dir), inputs.runs(spark, sf_dir))


def top_groups_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five groups of every run."""
    page = serving.top_groups_page(
        inputs.groups(spark, sf_dir), inputs.insights(spark, sf_dir), limit=5, offset=5
    )
    return page.select(
        "file_id", "position", "total", "group_id", "count", "template",
        F.col("payload.error_type").alias("error_type"),
    )


def run_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten runs of every tenant."""
    page = serving.run_history_page(
        inputs.runs(spark, sf_dir), inputs.files(spark, sf_dir), limit=10, offset=10
    )
    return page.select(
        "user_id", "position", "total", "file_id", "filename", "status", shown_time("created_at"),
        "total_lines", "error_lines",
    )


def classify_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule scorer on every group, before any guard."""
    requests = enrichment.scoring_requests(inputs.groups(spark, sf_dir))
    p = F.col("payload")
    return enrichment.classify(requests).select(
        "group_id",
        p["error_type"].alias("error_type"),
        p["severity"].alias("severity"),
        p["root_cause"].alias("root_cause"),
        F.array_join(p["possible_reasons"], "; ").alias("reasons"),
        p["explanation"].alias("explanation"),
        F.array_join(p["recommended_commands"], "; ").alias("commands"),
        p["confidence"].alias("confidence"),
    )


def _early_insights(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insights of the groups first seen before mid-month, and the groups of after it."""
    middle = F.lit("2024-01-16").cast("timestamp")
    early = groups.filter(F.col("first_seen") < middle)
    scored = enrichment.classify(enrichment.scoring_requests(early))
    cache = scored.join(
        early.select("group_id", "user_id", "fingerprint", F.col("first_seen").alias("created_at")),
        "group_id",
    ).withColumn("prompt_version", F.lit(fixed.PROMPT_VERSION))
    return cache, groups.filter(F.col("first_seen") >= middle)


def _shown_cache(looked_up: DataFrame) -> DataFrame:
    return looked_up.select(
        "group_id",
        F.col("cached_payload").isNotNull().alias("from_cache"),
        F.col("cached_payload.explanation").alias("explanation"),
        F.col("cached_version").alias("prompt_version"),
    )


def insight_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups first seen after mid-month against insights of the earlier ones."""
    cache, late = _early_insights(inputs.groups(spark, sf_dir))
    return _shown_cache(enrichment.with_cache(late, cache))


def stored_insight_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored cache, whose batch is delivered twice."""
    cache, late = _early_insights(inputs.groups(spark, sf_dir))
    path = new_path(spark, "insight-cache")
    for _ in range(2):
        stored_cache.write_cache(cache, path)
    return _shown_cache(stored_cache.with_stored_cache(late, path))


def enriched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = inputs.groups(spark, sf_dir)
    insights = enrichment.enrich(groups)
    refined = enrichment.refine_severity(groups, insights.select("group_id", "payload"))
    marks = insights.select("group_id", "from_cache")
    return refined.join(marks, "group_id", "left").select(
        "group_id",
        "file_id",
        "severity",
        "from_cache",
        F.col("payload.error_type").alias("error_type"),
        F.col("payload.explanation").alias("explanation"),
        F.array_join("payload.recommended_commands", "; ").alias("commands"),
    )


def insight_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload texts with faults seeded by the first digit of the fingerprint."""
    digit = F.substring("fingerprint", 1, 1)

    def listed(item: str, n: int) -> str:
        return "[" + ", ".join([f'"{item}"'] * n) + "]"

    kind = F.when(digit == "5", F.repeat(F.lit("x"), 65)).otherwise("Application Error")
    severity = F.when(digit == "0", "urgent").otherwise(F.col("severity"))
    cause = F.when(digit == "2", F.lit("")).otherwise(
        F.concat(F.lit('"root_cause": "seen '), F.col("count").cast("string"), F.lit(' times", '))
    )
    reasons = F.when(digit == "3", listed("a", 7)).otherwise(listed("a", 2))
    offered = F.when(digit == "6", listed("df -h", 9)).otherwise(
        '["kubectl get pods", "rm -rf /", " free -m "]'
    )
    confidence = F.when(digit == "1", "1.5").otherwise("0.5")
    end = F.when(digit == "4", "").otherwise("}")
    text = F.concat(
        F.lit('{"error_type": "'), kind, F.lit('", "severity": "'), severity, F.lit('", '), cause,
        F.lit('"possible_reasons": '), reasons,
        F.lit(', "explanation": "text", "suggested_fix": "text", "recommended_commands": '), offered,
        F.lit(', "confidence": '), confidence, end,
    )
    payload = enrichment.parse_payload(F.when(digit == "7", F.lit("[1]")).otherwise(text))
    groups = inputs.groups(spark, sf_dir).select("group_id", payload.alias("payload"))
    checked = enrichment.validate_payloads(groups)
    return checked.select(
        "group_id",
        (F.size("problems") == 0).alias("valid"),
        F.array_join("problems", "; ").alias("problems"),
        F.array_join("payload.recommended_commands", "; ").alias("commands"),
    )


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per run when a scorer is billed by the words of its prompts."""

    def billed(requests: DataFrame) -> DataFrame:
        words = F.size(F.split("prompt", r"\s+")).cast("long")
        usage = requests.select("group_id", words.alias("prompt_tokens"))
        rules = enrichment.classify(requests).drop("prompt_tokens", "completion_tokens", "model")
        return rules.join(usage, "group_id").select(
            "group_id", "payload", F.lit("by-word").alias("model"), "prompt_tokens",
            F.size(F.split("payload.explanation", " ")).cast("long").alias("completion_tokens"),
        )

    return enrichment.token_cost(enrichment.enrich(inputs.groups(spark, sf_dir), scorer=billed))


def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = enrichment.scoring_requests(inputs.groups(spark, sf_dir))
    return requests.select(
        "group_id",
        "prompt_version",
        F.length("prompt").cast("long").alias("chars"),
        F.sha2("prompt", 256).alias("prompt_sha"),
    )


def command_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of every group; without an insight it counts as an application error."""
    groups = inputs.enriched_groups(spark, sf_dir).select(
        "group_id", F.col("payload.error_type").alias("error_type")
    )
    return commands.suggest_commands(groups).select(
        "group_id", "error_type", "pos", "command", "description", "domain"
    )


def command_params_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters made from events, with hostile, missing and malformed values."""
    ids = [row[0] for row in fixed.COMMAND_CATALOG] + ["drop_tables"]
    event, k = F.col("event_id"), F.col("k").cast("string")
    chosen = F.get(F.array(*[F.lit(x) for x in ids]), (event % len(ids)).cast("int"))
    values = {
        "namespace": F.when(event % 7 == 0, "prod; rm -rf /").otherwise(F.concat(F.lit("team-"), k)),
        "pod": F.when(event % 5 == 0, F.lit("api-1\n")).otherwise(F.concat(F.lit("api-"), event.cast("string"))),
        "service": F.concat(F.lit("worker@"), k, F.lit(".service")),
        "host": F.when(event % 3 == 0, "$(id)").otherwise(F.concat(F.lit("db-"), k, F.lit(".internal"))),
        "port": F.when(event % 4 == 0, F.lit(None)).otherwise((F.col("k") * 1999).cast("string")),
        "log_group": F.concat(F.lit("/aws/app/"), k),
    }
    pairs = [x for name, value in values.items() for x in (F.lit(name), value)]
    requests = inputs.events(spark, sf_dir).select(
        "event_id", chosen.alias("template_id"), F.create_map(*pairs).alias("params")
    )
    return commands.render_commands(requests).drop("params")


def safe_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over commands that name each group: diagnostics and harmful ones."""
    tail = F.concat(F.lit(" "), F.substring("fingerprint", 1, 8))
    offered = F.array(*[F.concat(F.lit(c), tail) for c in OFFERED_COMMANDS])
    kept = filter_commands(offered)
    return inputs.groups(spark, sf_dir).select(
        "group_id", F.size(kept).cast("long").alias("kept"), F.array_join(kept, "; ").alias("commands")
    )


OFFERED_COMMANDS = [
    "kubectl get pods",
    " kubectl describe pod",
    "systemctl status",
    "journalctl -u",
    "docker logs",
    "ping -c 1",
    "nc -zv",
    "curl -sI",
    "df -h",
    "redis-cli ping",
    "aws ec2 describe-instances",
    "kubectl delete pod",
    "systemctl restart",
    "rm -rf",
    "curl -X POST",
    "kubectl get pods; rm",
    "df -h | tee",
    "ping $(id)",
    "free > /dev/null",
    "",
]


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.last_turns(inputs.table(spark, sf_dir, "conversations"))


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.conversation_history(inputs.table(spark, sf_dir, "conversations"))


def checked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts as questions against the accepted length."""
    messages = inputs.table(spark, sf_dir, "conversations")
    asked = messages.select("conv_id", "turn", F.col("text").alias("question"))
    return serving.checked_questions(asked).select(
        "conv_id", "turn", F.length("question").cast("long").alias("chars"), "reason"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "severity_breakdown": severity_breakdown,
    "top_groups_page": top_groups_page,
    "run_history_page": run_history_page,
    "classify_groups": classify_groups,
    "insight_cache": insight_cache,
    "stored_insight_cache": stored_insight_cache,
    "enriched_groups": enriched_groups,
    "insight_validation": insight_validation,
    "token_cost": token_cost,
    "scoring_requests": scoring_requests,
    "command_suggestions": command_suggestions,
    "command_params_check": command_params_check,
    "safe_commands": safe_commands,
    "last_turns": last_turns,
    "conversation_history": conversation_history,
    "checked_questions": checked_questions,
}
