"""Column expressions for text: levels, timestamps, templates, tokens, scrubbing.

Every function maps Columns to a Column and stays inside Spark SQL
expressions, so callers keep code generation and column pruning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark import fixed

STRICT_JSON = {"allowSingleQuotes": "false"}  # the reader accepts single quotes unless told not to


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column used inside a lambda is evaluated again for every element; the
    variable of a one-element ``transform`` is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every ASCII whitespace character, not only the space."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def in_list(value: Column, options: list[str]) -> Column:
    return value.isin(*options)


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    """Constant dictionary lookup; null when the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def normalize_level(raw: Column, more: dict[str, str] | None = None) -> Column:
    """Level of the vocabulary, or null; ``more`` adds aliases of one format."""
    vocabulary = {**{x: x for x in fixed.LEVELS}, **fixed.LEVEL_ALIASES, **(more or {})}
    return lookup(F.lower(strip(raw)), vocabulary)


def severity_of_level(level: Column) -> Column:
    return lookup(level, fixed.SEVERITY_BY_LEVEL)


def severity_rank(severity: Column) -> Column:
    ranks = F.array(*[F.lit(s) for s in fixed.SEVERITIES])
    position = F.array_position(ranks, severity)
    return F.when(position > 0, position - 1).otherwise(F.lit(fixed.UNKNOWN_SEVERITY_RANK)).cast("int")


def parse_timestamp(raw: Column) -> Column:
    """Read the accepted timestamp shapes as an instant; text without a zone is UTC.

    Two shape checks decide what is accepted, then one cast reads it.  A cast is
    much cheaper than a chain of format attempts, each of which raises inside.
    """

    def read(text: Column) -> Column:
        accepted = text.rlike(fixed.TIMESTAMP_SPACED) | text.rlike(fixed.TIMESTAMP_ISO)
        dotted = F.replace(text, F.lit(","), F.lit("."))
        zoned = F.when(text.rlike(fixed.TIMESTAMP_ZONED), dotted).otherwise(F.concat(dotted, F.lit("Z")))
        return F.when(accepted, zoned.try_cast("timestamp"))

    return let(strip(raw), read)


def template_rules(rule_set: str = "compat") -> list[tuple[str, str]]:
    """The ordered substitutions; ``iso_fixed`` also catches lower-cased ISO times."""
    if rule_set == "compat":
        return fixed.TEMPLATE_RULES
    if rule_set == "iso_fixed":
        return [
            (fixed.ISO_FIXED_TIMESTAMP_RULE if mark == "<ts>" else pattern, mark)
            for pattern, mark in fixed.TEMPLATE_RULES
        ]
    raise ValueError(f"unknown template rule set: {rule_set}")


# a character without which a rule cannot match; most messages have few of them
_NEEDED = {"<uuid>": "-", "<ts>": ":", "<ip>": ".", "<path>": "/"}


def _apply_rule(text: Column, pattern: str, mark: str) -> Column:
    """Replace by one rule; a character search spares most texts the regex."""
    replaced = lambda t: F.regexp_replace(t, F.lit(pattern), F.lit(mark))
    needed = pattern[0] if mark == "<str>" else _NEEDED.get(mark)
    if needed is None:
        return replaced(text)
    return let(text, lambda t: F.when(F.contains(t, F.lit(needed)), replaced(t)).otherwise(t))


def _first(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def template_of(message: Column, rule_set: str = "compat", max_chars: int | None = None) -> Column:
    """The message with everything variable replaced by marks; ``max_chars`` keeps only its beginning.

    The result is null-free, which lets the planner drop null checks that would
    repeat the rules.
    """
    marked = reduce(
        lambda text, rule: _apply_rule(text, *rule), template_rules(rule_set), F.lower(strip(message))
    )
    return F.coalesce(_first(strip(marked), max_chars), F.lit(""))


def fingerprint(level: Column, template: Column) -> Column:
    return F.sha2(F.concat(level, F.lit("|"), template), 256)


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)


def retrieval_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text, fixed.RETRIEVAL_TOKEN))


def question_tokens(question: Column) -> Column:
    stop_words = F.array(*[F.lit(w) for w in fixed.STOP_WORDS])
    return F.array_except(retrieval_tokens(question), stop_words)


def scrub(text: Column, max_chars: int | None = None) -> Column:
    """Neutralise fence look-alikes; ``max_chars`` keeps only the beginning."""
    clean = F.regexp_replace(text, F.lit(fixed.FENCE_LOOKALIKE), F.lit(fixed.FENCE_REPLACEMENT))
    return _first(clean, max_chars)


def fence(lines: Column) -> Column:
    """Wrap an array of scrubbed lines in the data fence."""
    body = F.array_join(F.transform(lines, lambda line: scrub(line)), "\n")
    return F.concat(F.lit(fixed.FENCE_OPEN + "\n"), body, F.lit("\n" + fixed.FENCE_CLOSE))
