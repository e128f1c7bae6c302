"""Diagnostic commands: a fixed catalog, suggestions per error type, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.guards import param_problems

_DEFAULT_TYPE = "__default__"


def command_catalog(spark: SparkSession) -> DataFrame:
    """The 12 templates as a table: a fixed size, always safe to broadcast."""
    schema = "template_id string, domain string, template string, description string, params array<string>"
    return spark.createDataFrame(fixed.COMMAND_CATALOG, schema)


def suggestions(spark: SparkSession) -> DataFrame:
    """Ordered template ids per error type, with a list for every other type."""
    lists = {**fixed.COMMANDS_BY_ERROR_TYPE, _DEFAULT_TYPE: fixed.DEFAULT_COMMANDS}
    rows = [(kind, pos, tid) for kind, ids in lists.items() for pos, tid in enumerate(ids)]
    return spark.createDataFrame(rows, "list_type string, pos int, template_id string")


def render(template: Column, values: Column) -> Column:
    """Put parameter values into ``{name}`` marks."""
    return reduce(
        lambda text, name: F.replace(
            text, F.lit("{" + name + "}"), F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(""))
        ),
        fixed.PARAM_PATTERNS,
        template,
    )


def render_commands(requests: DataFrame) -> DataFrame:
    """Validate and render ``template_id, params``; rejected rows keep a reason.

    An unknown template or a missing or malformed value is rejected.
    """
    catalog = command_catalog(requests.sparkSession).withColumnRenamed("params", "required")
    joined = requests.join(F.broadcast(catalog), "template_id", "left")
    broken = param_problems(F.col("params"), F.col("required"))
    reason = F.when(F.col("template").isNull(), F.lit("unknown template")).when(
        F.size(broken) > 0, F.concat(F.lit("invalid "), F.array_join(broken, ", "))
    )
    return joined.withColumn("reason", reason).select(
        *requests.columns,
        F.when(F.col("reason").isNull(), render(F.col("template"), F.col("params"))).alias("command"),
        "reason",
    )


def suggestion_table(spark: SparkSession, defaults: dict[str, str] | None = None) -> DataFrame:
    """``list_type, pos, command, description, domain`` with default parameters.

    Rows whose parameters fail validation are left out.
    """
    values = {**fixed.PARAM_DEFAULTS, **(defaults or {})}
    params = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    rendered = render_commands(suggestions(spark).withColumn("params", params))
    catalog = F.broadcast(command_catalog(spark).select("template_id", "description", "domain"))
    return rendered.filter(F.col("reason").isNull()).join(catalog, "template_id").select(
        "list_type", "pos", "command", "description", "domain"
    )


def _list_type(error_type: Column) -> Column:
    known = error_type.isin(*fixed.COMMANDS_BY_ERROR_TYPE)
    return F.when(known, error_type).otherwise(F.lit(_DEFAULT_TYPE))


def suggest_commands(groups: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Ordered commands for each row by its error type; no type means application error.

    The suggestion table is a fixed handful of rows, so it is broadcast.
    """
    table = F.broadcast(suggestion_table(groups.sparkSession))
    kind = F.coalesce(F.col(error_type), F.lit(fixed.CLASSIFIER_FALLBACK["error_type"]))
    return groups.withColumn("list_type", _list_type(kind)).join(table, "list_type").drop("list_type")


def command_lists(spark: SparkSession) -> DataFrame:
    """Per list type, the suggestions as one ordered array of ``command, description``."""
    entry = F.struct("pos", "command", "description")
    ordered = F.array_sort(F.collect_list(entry)).alias("commands")
    return suggestion_table(spark).groupBy("list_type").agg(ordered)


def with_command_list(groups: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Add the ordered command array of a row's error type; null without a type."""
    lists = F.broadcast(command_lists(groups.sparkSession))
    kind = F.when(F.col(error_type).isNotNull(), _list_type(F.col(error_type)))
    return groups.withColumn("list_type", kind).join(lists, "list_type", "left").drop("list_type")
