"""Validation expressions: safe commands, command parameters, insight payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark import fixed
from logspark.functions.text import strip

INSIGHT_PAYLOAD = T.StructType(
    [
        T.StructField("error_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("root_cause", T.StringType()),
        T.StructField("possible_reasons", T.ArrayType(T.StringType())),
        T.StructField("explanation", T.StringType()),
        T.StructField("suggested_fix", T.StringType()),
        T.StructField("recommended_commands", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def is_safe_command(command: Column) -> Column:
    """Read-only diagnostics only: allow-listed, short, and free of shell syntax."""
    text = strip(command)
    listed = reduce(lambda a, b: a | b, [text.rlike(p) for p in fixed.SAFE_COMMAND_PATTERNS])
    plain = ~text.rlike(fixed.SHELL_METACHARACTERS)
    return (text != "") & (F.length(text) <= fixed.COMMAND_CHARS) & plain & listed


def filter_commands(commands: Column) -> Column:
    return F.transform(F.filter(commands, is_safe_command), strip)


def param_problems(values: Column, names: Column) -> Column:
    """Names of the required parameters whose value is missing or malformed, in order.

    ``values`` is a ``map<string,string>`` and ``names`` the required names.
    """

    def broken(name: Column) -> Column:
        value = F.coalesce(F.try_element_at(values, name), F.lit(""))
        checks = [
            (name == F.lit(known)) & value.rlike(rf"\A(?:{pattern})\z")
            for known, pattern in fixed.PARAM_PATTERNS.items()
        ]
        return ~reduce(lambda a, b: a | b, checks)

    return F.filter(names, broken)


def insight_problems(payload: Column) -> Column:
    """Reasons why a parsed payload must not be stored; an empty array means valid."""
    p = payload

    def required(name: str) -> Column:
        return F.when(p[name].isNull(), F.lit(f"{name}: missing"))

    def capped(name: str, limit: int) -> Column:
        return F.when(F.length(p[name]) > limit, F.lit(f"{name}: too long"))

    checks = [
        F.when(p.isNull(), F.lit("payload: not an object")),
        *[
            F.when(p.isNotNull(), required(name))
            for name in (
                "error_type",
                "severity",
                "root_cause",
                "possible_reasons",
                "explanation",
                "suggested_fix",
                "confidence",
            )
        ],
        capped("error_type", fixed.ERROR_TYPE_CHARS),
        F.when(~p["severity"].isin(*fixed.SEVERITIES), F.lit("severity: not allowed")),
        capped("root_cause", fixed.ROOT_CAUSE_CHARS),
        capped("explanation", fixed.EXPLANATION_CHARS),
        capped("suggested_fix", fixed.SUGGESTED_FIX_CHARS),
        F.when(F.size(p["possible_reasons"]) > fixed.MAX_REASONS, F.lit("possible_reasons: too many")),
        F.when(
            F.size(p["recommended_commands"]) > fixed.MAX_COMMANDS,
            F.lit("recommended_commands: too many"),
        ),
        F.when(~p["confidence"].between(0.0, 1.0), F.lit("confidence: out of range")),
    ]
    return F.array_compact(F.array(*checks))
