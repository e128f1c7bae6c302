"""Classification of error groups: rules, cache, validation, refinement, cost.

A scorer is any function from a scoring-request table to a table with
``group_id, payload, model, prompt_tokens, completion_tokens``.  The rule scorer
is built in; a Python scorer plugs in through ``python_scorer``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark import fixed
from logspark.functions.guards import INSIGHT_PAYLOAD, filter_commands, insight_problems
from logspark.functions.text import STRICT_JSON, fence, severity_of_level
from logspark.operators.scale import cut, join_to_many, number_rows

Scorer = Callable[[DataFrame], DataFrame]
CACHE_KEY = ["user_id", "fingerprint"]


def top_groups(groups: DataFrame, n: int | None, run: str = "file_id") -> DataFrame:
    """The ``n`` most frequent groups of every run, or all, with their rank; ties by fingerprint."""
    if n is None:
        return number_rows(groups, [run], [F.desc("count"), F.asc("fingerprint")], "group_rank")
    order = Window.partitionBy(run).orderBy(F.desc("count"), F.asc("fingerprint"))
    ranked = groups.withColumn("group_rank", F.row_number().over(order))
    return ranked.filter(F.col("group_rank") <= n)


# --- scoring requests ---------------------------------------------------------------


def scoring_requests(groups: DataFrame) -> DataFrame:
    """One prompt text per group, with scrubbed and fenced sample lines."""
    note = F.when(F.col("format").isNull(), F.lit("")).otherwise(
        F.format_string(fixed.REQUEST_FORMAT_NOTE, "format")
    )
    prompt = F.format_string(
        fixed.REQUEST_TEXT, note, "level", "count", "template", fence(F.col("sample_lines"))
    )
    return groups.select(
        "group_id",
        "level",
        "template",
        "count",
        "sample_lines",
        prompt.alias("prompt"),
        F.lit(fixed.PROMPT_VERSION).alias("prompt_version"),
    )


# --- rule scorer ----------------------------------------------------------------------


def _rule_constants(rule: dict[str, Any]) -> Column:
    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return F.struct(
        F.lit(rule["severity"]).cast("string").alias("severity"),
        F.lit(rule["error_type"]).alias("error_type"),
        F.lit(rule["root_cause"]).alias("root_cause"),
        texts(rule["possible_reasons"]).alias("possible_reasons"),
        F.lit(rule["suggested_fix"]).alias("suggested_fix"),
        texts(rule["recommended_commands"]).alias("recommended_commands"),
        F.lit(rule["confidence"]).alias("confidence"),
    )


def classify(requests: DataFrame) -> DataFrame:
    """Built-in scorer: the rule with most keywords in template and samples wins.

    A rule needs two hits and strictly more than every earlier rule.
    """
    haystack = F.lower(F.concat_ws(" ", "template", F.array_join("sample_lines", " ")))

    def hits(rule: dict[str, Any]) -> Column:
        found = [F.contains("_haystack", F.lit(k)).cast("int") for k in rule["keywords"]]
        return reduce(lambda a, b: a + b, found)

    scores = [f"_hits{i}" for i in range(len(fixed.CLASSIFIER_RULES))]
    scored = requests.withColumn("_haystack", haystack).select(
        "*", *[hits(r).alias(name) for name, r in zip(scores, fixed.CLASSIFIER_RULES, strict=True)]
    )
    best = F.greatest(*scores)
    chosen = F.when(best < fixed.CLASSIFIER_MIN_HITS, _rule_constants(fixed.CLASSIFIER_FALLBACK))
    for name, rule in zip(scores, fixed.CLASSIFIER_RULES, strict=True):
        chosen = chosen.when(F.col(name) == best, _rule_constants(rule))
    rule = F.col("_rule")
    explanation = F.concat(
        F.lit("This group occurred "),
        F.col("count").cast("string"),
        F.lit(" time(s). "),
        rule["root_cause"],
        F.lit(" " + fixed.EXPLANATION_TAIL),
    )
    severity = F.coalesce(rule["severity"], severity_of_level(F.col("level")), F.lit("low"))
    payload = F.struct(
        rule["error_type"].alias("error_type"),
        severity.alias("severity"),
        rule["root_cause"].alias("root_cause"),
        rule["possible_reasons"].alias("possible_reasons"),
        explanation.alias("explanation"),
        rule["suggested_fix"].alias("suggested_fix"),
        rule["recommended_commands"].alias("recommended_commands"),
        rule["confidence"].alias("confidence"),
    )
    return scored.withColumn("_rule", chosen).select(
        "group_id",
        payload.alias("payload"),
        F.lit(fixed.RULES_MODEL).alias("model"),
        F.lit(0).cast("long").alias("prompt_tokens"),
        F.lit(0).cast("long").alias("completion_tokens"),
    )


def python_scorer(score: Callable[[list[str]], list[tuple[str, int, int]]], model: str) -> Scorer:
    """Scorer from a Python function over a batch of prompts.

    The function returns ``(payload JSON, prompt tokens, completion tokens)`` per
    prompt.  Text that is not a valid payload simply yields no insight.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scored = score(frame["prompt"].tolist())
            yield pd.DataFrame(
                {
                    "group_id": frame["group_id"].to_numpy(),
                    "json": [s[0] for s in scored],
                    "prompt_tokens": [s[1] for s in scored],
                    "completion_tokens": [s[2] for s in scored],
                }
            )

    def run(requests: DataFrame) -> DataFrame:
        raw = requests.select("group_id", "prompt").mapInPandas(
            batches, "group_id string, json string, prompt_tokens long, completion_tokens long"
        )
        return raw.select(
            "group_id",
            parse_payload(F.col("json")).alias("payload"),
            F.lit(model).alias("model"),
            "prompt_tokens",
            "completion_tokens",
        )

    return run


# --- validation -------------------------------------------------------------------------


def parse_payload(json: Column) -> Column:
    """A payload struct from JSON text; null when the text is not one object."""
    text = F.btrim(json)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(INSIGHT_PAYLOAD), STRICT_JSON)
    only = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
    return F.when(text.startswith("{") & text.endswith("}"), only)


def validate_payloads(scored: DataFrame) -> DataFrame:
    """Add ``problems``, default and filter the commands; nothing is dropped here."""
    commands = F.coalesce(F.col("payload.recommended_commands"), F.array().cast("array<string>"))
    checked = scored.withColumn("problems", insight_problems(F.col("payload")))
    kept = F.col("payload").withField("recommended_commands", filter_commands(commands))
    return checked.withColumn("payload", F.when(F.col("payload").isNotNull(), kept))


# --- cache and enrichment -----------------------------------------------------------------


def latest_cached(cache: DataFrame) -> DataFrame:
    """One cached insight per tenant and fingerprint: the newest, ties by group."""
    order = Window.partitionBy(*CACHE_KEY).orderBy(F.desc("created_at"), F.asc("group_id"))
    newest = cache.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1)
    return newest.select(
        *CACHE_KEY,
        F.col("payload").alias("cached_payload"),
        F.col("model").alias("cached_model"),
        F.col("prompt_version").alias("cached_version"),
    )


def with_cache(groups: DataFrame, cache: DataFrame, prompt_version: str | None = None) -> DataFrame:
    """Left join groups to the cache; ``cached_payload`` is null on a miss."""
    hits = latest_cached(cache)
    if prompt_version is not None:
        hits = hits.filter(F.col("cached_version") == prompt_version)
    return join_to_many(groups, hits, CACHE_KEY, "group_id", "cache")


def enrich(
    groups: DataFrame,
    cache: DataFrame | None = None,
    scorer: Scorer = classify,
    max_groups: int | None = None,
) -> DataFrame:
    """Insights for all groups of every run, or its ``max_groups`` largest.

    A problem that many runs of a tenant share is scored once, for the earliest
    run, and the other runs take that insight as a cache hit.  Scored payloads
    must pass validation; a failing one yields no insight and no failed run.
    """
    picked = groups if max_groups is None else top_groups(groups, max_groups)
    top = cut(picked, "top_groups")  # read three times
    if cache is not None:
        top = with_cache(top, cache)
    else:
        top = top.select(
            "*",
            F.lit(None).cast(INSIGHT_PAYLOAD).alias("cached_payload"),
            F.lit(None).cast("string").alias("cached_model"),
            F.lit(None).cast("string").alias("cached_version"),
        )
    first_run = Window.partitionBy(*CACHE_KEY).orderBy("file_id")
    to_score = (
        top.filter(F.col("cached_payload").isNull())
        .withColumn("_turn", F.row_number().over(first_run))
        .filter(F.col("_turn") == 1)
    )
    scored = validate_payloads(scorer(scoring_requests(to_score)))
    valid = scored.filter(F.size("problems") == 0).drop("problems")
    by_key = valid.join(to_score.select("group_id", *CACHE_KEY), "group_id").select(
        *CACHE_KEY,
        F.col("group_id").alias("_scored_group"),
        F.col("payload").alias("_payload"),
        F.col("model").alias("_model"),
        "prompt_tokens",
        "completion_tokens",
    )
    joined = join_to_many(top, by_key, CACHE_KEY, "group_id", "scored")
    own = F.col("_scored_group") == F.col("group_id")
    hit = F.col("cached_payload").isNotNull()
    return joined.select(
        "file_id",
        "group_id",
        *CACHE_KEY,
        F.coalesce("cached_payload", "_payload").alias("payload"),
        F.coalesce("cached_model", "_model").alias("model"),
        F.coalesce("cached_version", F.lit(fixed.PROMPT_VERSION)).alias("prompt_version"),
        (hit | ~own).alias("from_cache"),
        F.when(own & ~hit, F.col("prompt_tokens")).otherwise(F.lit(0)).alias("prompt_tokens"),
        F.when(own & ~hit, F.col("completion_tokens")).otherwise(F.lit(0)).alias("completion_tokens"),
    ).filter(F.col("payload").isNotNull())


def refine_severity(groups: DataFrame, insights: DataFrame) -> DataFrame:
    """Add the insight and let its severity override the one from the level."""
    joined = groups.join(insights.select("group_id", "payload"), "group_id", "left")
    stated = F.col("payload.severity")
    allowed = stated.isin(*fixed.SEVERITIES)
    return joined.withColumn("severity", F.when(allowed, stated).otherwise(F.col("severity")))


def token_cost(insights: DataFrame, run: str = "file_id") -> DataFrame:
    """Tokens and cache share per run and model."""
    return insights.groupBy(run, "model").agg(
        F.count(F.lit(1)).alias("insights"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.avg(F.col("from_cache").cast("int")), 4).alias("cached_share"),
    )
