"""Log formats: detection per file and parsing of each line by its file's format.

A format is a registry entry of Column builders:

- ``may_match(line)`` is a cheap test that every line of the format passes;
- ``extract(line)`` does the heavy work once, as one intermediate column;
- ``matched(extracted)`` tells whether the line is of the format;
- ``fields(line, raw, extracted, year)`` picks level, time text, message and text;
- ``clean(message)`` turns the picked message into its plain form.

Adding a format means adding an entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.text import STRICT_JSON, is_blank, let, lookup, normalize_level, parse_timestamp, strip
from logspark.operators.scale import join_to_many
from logspark.sources.lines import counted_lines, head_sample

_FIELD = "\u0001"  # separates captured groups in one regex pass


def _same(text: Column) -> Column:
    return text


def _always(line: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class LogFormat:
    name: str
    extract: Callable[[Column], Column]
    matched: Callable[[Column], Column]
    fields: Callable[[Column, Column, Column, int], Column]
    clean: Callable[[Column], Column] = _same
    may_match: Callable[[Column], Column] = _always


def _fields(level: Column, time: Column, message: Column, text: Column) -> Column:
    return F.struct(
        F.lit(True).alias("parsed"),
        level.alias("level"),
        time.alias("time_text"),
        message.alias("message_text"),
        text.alias("text"),
    )


def _captured(line: Column, pattern: str, groups: int) -> Column:
    """All groups of an anchored pattern, or null, from one match: a line that does not match stays as it is."""
    marks = _FIELD.join(f"${i}" for i in range(1, groups + 1))
    replaced = F.regexp_replace(line, F.lit(pattern), F.lit(marks))
    return let(replaced, lambda found: F.when(found != line, F.split(found, _FIELD, groups)))


# --- JSON lines -------------------------------------------------------------------


def _json_object(line: Column) -> Column:
    """The object a line consists of, or null.

    The JSON reader stops after the first value and ignores what follows.  Read
    as the only element of a list, a line with trailing text is malformed.
    """
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", STRICT_JSON)
    only = F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))
    return F.when(line.startswith("{") & line.endswith("}"), only)


def _json_pairs(line: Column) -> Column:
    """Keys and values, last pair first, so that a lookup finds the last duplicate."""

    def pairs(obj: Column) -> Column:
        return F.struct(
            F.reverse(F.map_keys(obj)).alias("keys"), F.reverse(F.map_values(obj)).alias("vals")
        )

    return let(_json_object(line), lambda obj: F.when(obj.isNotNull(), pairs(obj)))


def _value_of(pairs: Column, key: str) -> Column:
    """Value of a key in a pair list; null when the key is absent."""
    return F.get(pairs["vals"], (F.array_position(pairs["keys"], key) - 1).cast("int"))


def _first_present(pairs: Column, keys: list[str]) -> Column:
    """Value of the first key that exists, even when that value is null."""
    cases = F.when(F.array_contains(pairs["keys"], keys[0]), _value_of(pairs, keys[0]))
    for key in keys[1:]:
        cases = cases.when(F.array_contains(pairs["keys"], key), _value_of(pairs, key))
    return cases


def _json_fields(line: Column, raw: Column, pairs: Column, year: int) -> Column:
    return _fields(
        normalize_level(_first_present(pairs, fixed.JSON_LEVEL_KEYS)),
        _first_present(pairs, fixed.JSON_TIME_KEYS),
        F.coalesce(_first_present(pairs, fixed.JSON_MESSAGE_KEYS), line),
        line,
    )


# --- logfmt -----------------------------------------------------------------------


# fixed.LOGFMT_PAIR with the same matches; a loop over the characters of a quoted value, not over a group of them
_LOGFMT_PAIR = fixed.LOGFMT_PAIR.replace(r'"(?:[^"\\]|\\.)*"', r'"[^"\\]*(?:\\.[^"\\]*)*"')


def _logfmt_pairs(line: Column) -> Column:
    """Keys and values, last pair first, so that a lookup finds the last duplicate.

    A key holds no ``=``, so one pass finds the pairs and the first ``=`` cuts each.
    """
    def pairs(found: Column) -> Column:
        return F.struct(
            F.reverse(F.transform(found, lambda x: F.substring_index(x, "=", 1))).alias("keys"),
            F.reverse(F.transform(found, lambda x: F.substring(x, F.instr(x, "=") + 1, F.length(x)))).alias("vals"),
        )

    return let(F.regexp_extract_all(line, F.lit(_LOGFMT_PAIR), 0), pairs)


def _logfmt_matched(pairs: Column) -> Column:
    known = F.array(*[F.lit(k) for k in fixed.LOGFMT_KNOWN_KEYS])
    return (F.size(F.array_distinct(pairs["keys"])) >= 2) & F.arrays_overlap(pairs["keys"], known)


def _logfmt_value(pairs: Column, *keys: str) -> Column:
    return F.coalesce(*[_value_of(pairs, key) for key in keys])


def _without_quotes(text: Column) -> Column:
    """Enough for levels and times, which never hold an escaped quote."""
    return F.regexp_replace(text, r'^"(.*)"$', "$1")


def _logfmt_fields(line: Column, raw: Column, pairs: Column, year: int) -> Column:
    message = F.nullif(_logfmt_value(pairs, "msg", "message"), F.lit('""'))
    return _fields(
        normalize_level(_without_quotes(_logfmt_value(pairs, "level"))),
        _without_quotes(_logfmt_value(pairs, "time", "ts")),
        F.coalesce(message, line),
        line,
    )


def _logfmt_unquote(text: Column) -> Column:
    quoted = text.startswith('"') & text.endswith('"')
    inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    return F.when(quoted, F.replace(inner, F.lit('\\"'), F.lit('"'))).otherwise(text)


# --- syslog -----------------------------------------------------------------------


def _syslog_fields(line: Column, raw: Column, fields: Column, year: int) -> Column:
    months = {name: f"{number:02d}" for number, name in enumerate(fixed.MONTHS, 1)}
    stamp = F.concat(
        F.lit(f"{year:04d}-"),
        lookup(F.get(fields, F.lit(0)), months),
        F.lit("-"),
        F.lpad(F.get(fields, F.lit(1)), 2, "0"),
        F.lit(" "),
        F.get(fields, F.lit(2)),
    )
    message = F.get(fields, F.lit(6))
    word = F.regexp_extract(message, fixed.SYSLOG_LEVEL_WORD, 1)
    return _fields(normalize_level(word, _SYSLOG_WORDS), stamp, message, raw)


# no level word means info; failure words mean error
_SYSLOG_WORDS = {"": "info", "fail": "error", "failed": "error", "failure": "error"}


# --- freeform ---------------------------------------------------------------------


def _plain_fields(line: Column, raw: Column, fields: Column, year: int) -> Column:
    message = F.coalesce(F.nullif(F.get(fields, F.lit(2)), F.lit("")), raw)
    hinted = F.when(message.rlike(fixed.PLAIN_ERROR_HINT), F.lit("error"))
    level = F.coalesce(normalize_level(F.get(fields, F.lit(1))), hinted)
    return _fields(level, F.get(fields, F.lit(0)), message, raw)


# --- registry ---------------------------------------------------------------------

REGISTRY: list[LogFormat] = [
    LogFormat("json", _json_pairs, lambda pairs: pairs.isNotNull(), _json_fields, may_match=lambda line: line.startswith("{")),
    LogFormat(
        "logfmt", _logfmt_pairs, _logfmt_matched, _logfmt_fields, clean=_logfmt_unquote, may_match=lambda line: line.contains("=")
    ),
    LogFormat(
        "syslog",
        lambda line: _captured(line, fixed.SYSLOG_LINE, 7),
        lambda fields: fields.isNotNull(),
        _syslog_fields,
        may_match=lambda line: F.substring(line, 1, 3).isin(*fixed.MONTHS),
    ),
    LogFormat(
        "plain",
        lambda line: _captured(line, fixed.PLAIN_LINE, 3),
        lambda fields: F.lit(True),
        _plain_fields,
    ),
]


def _best_format(scores: list[tuple[str, Column]], fallback: str) -> Column:
    """The first format that reaches the best score, if that score is trusted."""
    best = F.greatest(*[F.coalesce(score, F.lit(0.0)) for _, score in scores])
    ladder = reduce(
        lambda case, item: case.when(item[1] == best, F.lit(item[0])),
        scores[1:],
        F.when(scores[0][1] == best, F.lit(scores[0][0])),
    )
    return F.when(best >= fixed.MIN_FORMAT_SCORE, ladder).otherwise(F.lit(fallback))


def _matches(fmt: LogFormat, line: Column) -> Column:
    """Whether the line is of the format; most lines of other formats fail the cheap test already."""
    matched = let(fmt.extract(line), lambda extracted: F.coalesce(fmt.matched(extracted), F.lit(False)))
    return F.when(fmt.may_match(line), matched).otherwise(F.lit(False))


def detect_formats(
    lines: DataFrame, registry: list[LogFormat] = REGISTRY, head_lines: int | None = None
) -> DataFrame:
    """One row per file with lines: ``file_id, format`` and the scores.

    All lines count unless ``head_lines`` names a sample.  Shares are partial sums, so
    a row per file and task moves.
    """
    specific = registry[:-1]
    line = strip(F.col("raw"))
    sample = head_sample(lines, head_lines).select("file_id", *[_matches(f, line).cast("int").alias(f.name) for f in specific])
    scored = sample.groupBy("file_id").agg(*[F.avg(f.name).alias(f.name) for f in specific])
    scores = [(f.name, F.col(f.name)) for f in specific]
    return scored.select(
        "file_id",
        _best_format(scores, registry[-1].name).alias("format"),
        *[F.round(f.name, 4).alias(f"{f.name}_score") for f in specific],
    )


def format_of_text(
    lines: Column, registry: list[LogFormat] = REGISTRY, head_lines: int | None = None
) -> Column:
    """Format of an array of lines inside one row: a pasted text needs no shuffle."""
    head = lines if head_lines is None else F.slice(lines, 1, head_lines)
    sample = F.filter(head, lambda x: ~is_blank(x))
    total = F.size(sample)

    def score(fmt: LogFormat) -> Column:
        hits = F.size(F.filter(sample, lambda x: fmt.matched(fmt.extract(strip(x)))))
        return F.when(total > 0, hits / total).otherwise(F.lit(0.0))

    return _best_format([(f.name, score(f)) for f in registry[:-1]], registry[-1].name)


def attach_formats(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Add each file's format to its lines; files without a sample are freeform."""
    joined = join_to_many(
        lines, formats.select("file_id", "format"), ["file_id"], "line_no", "formats"
    )
    return joined.withColumn("format", F.coalesce("format", F.lit(REGISTRY[-1].name)))


def _by_format(registry: list[LogFormat], build: Callable[[LogFormat], Column]) -> Column:
    """``CASE format`` over the registry, so only the line's own branch is evaluated."""
    return reduce(
        lambda case, fmt: case.when(F.col("format") == fmt.name, build(fmt)),
        registry[1:],
        F.when(F.col("format") == registry[0].name, build(registry[0])),
    )


def parse_lines(
    lines: DataFrame, year: int, registry: list[LogFormat] = REGISTRY
) -> DataFrame:
    """Parse the non-blank lines of ``file_id, line_no, raw, format``.

    Adds ``parsed, level, ts, message, text``.  Each intermediate is computed only
    for lines of its format.  ``year`` completes syslog dates, which carry none.

    The picked fields leave through ``inline``.  A later filter on the level then
    tests a plain column, instead of dragging a second copy of the parsers below.
    They are picked inside ``let``, because the generated code of all formats together
    is one method, which is too long for the JVM to compile.
    """
    line = F.col("_line")
    staged = counted_lines(lines).withColumn("_line", strip(F.col("raw")))

    def picked(fmt: LogFormat) -> Column:
        def fields(extracted: Column) -> Column:
            return F.when(fmt.matched(extracted), fmt.fields(line, F.col("raw"), extracted, year))

        return let(fmt.extract(line), fields)

    rows = staged.select(*lines.columns, F.inline(F.array(_by_format(registry, picked))))

    return rows.select(
        *lines.columns,
        F.coalesce("parsed", F.lit(False)).alias("parsed"),
        "level",
        parse_timestamp(F.col("time_text")).alias("ts"),
        _by_format(registry, lambda fmt: fmt.clean(F.col("message_text"))).alias("message"),
        "text",
    )


def syslog_fields(lines: DataFrame) -> DataFrame:
    """Host, process and pid of syslog lines, which the line entry does not carry."""
    fields = F.col("_fields")
    return (
        lines.withColumn("_fields", _captured(strip(F.col("raw")), fixed.SYSLOG_LINE, 7))
        .filter(fields.isNotNull())
        .select(
            "file_id",
            "line_no",
            F.get(fields, F.lit(3)).alias("host"),
            F.get(fields, F.lit(4)).alias("process"),
            F.nullif(F.get(fields, F.lit(5)), F.lit("")).alias("pid"),
        )
    )


def parse_log(lines: DataFrame, year: int) -> DataFrame:
    """Detect, attach and parse in one go."""
    return parse_lines(attach_formats(lines, detect_formats(lines)), year)
