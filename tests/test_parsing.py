from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.functions.text import fingerprint, normalize_level, parse_timestamp, template_of
from logspark.operators import grouping, parsing

JSON = [
    '{"time": "2026-03-01T08:00:01Z", "level": "warn", "msg": "cache miss rate 91"}',
    '{"time": "2026-03-01T08:00:02Z", "level": "fatal", "msg": "disk gone"}',
]
SYSLOG = ["Mar  1 08:00:01 db-2 postgres[77]: checkpoint Failed on wal", "Mar 1 08:00:02 db-2 cron: job done"]
LOGFMT = [
    'time=2026-03-01T08:00:01Z level=error msg="queue \\"mail\\" stuck" n=4',
    "ts=2026-03-01T08:00:02Z level=info msg=ok",
]
PLAIN = ["2026-03-01 08:00:01,250 [ERROR] worker died", "peer refused the handshake"]


def parsed(lines, year=2026):
    rows = parsing.parse_log(lines, year).orderBy("file_id", "line_no").collect()
    return [r.asDict() for r in rows]


def test_each_format_is_detected(lines_of):
    lines = lines_of({1: JSON, 2: SYSLOG, 3: LOGFMT, 4: PLAIN, 5: ["  ", ""]})
    found = {r.file_id: r.format for r in parsing.detect_formats(lines).collect()}
    assert found == {1: "json", 2: "syslog", 3: "logfmt", 4: "plain"}
    attached = parsing.attach_formats(lines, parsing.detect_formats(lines))
    assert {r.format for r in attached.filter("file_id = 5").collect()} == {"plain"}


def test_format_of_a_text_matches_detection(spark, lines_of):
    files = {1: JSON, 2: SYSLOG, 3: LOGFMT, 4: PLAIN}
    texts = spark.createDataFrame([(k, v) for k, v in files.items()], "file_id long, lines array<string>")
    one_row = texts.select("file_id", parsing.format_of_text(F.col("lines")).alias("format"))
    many = parsing.detect_formats(lines_of(files)).select("file_id", "format")
    assert sorted(one_row.collect()) == sorted(many.collect())


def test_json_fields(lines_of):
    first, second = parsed(lines_of({1: JSON}))
    assert (first["level"], first["message"]) == ("warning", "cache miss rate 91")
    assert first["ts"] == datetime(2026, 3, 1, 8, 0, 1)
    assert second["level"] == "critical"


def test_json_first_present_key_wins_even_when_null(lines_of):
    row = parsed(lines_of({1: ['{"message": null, "msg": "later", "level": "error"}', '{"a": 1}']}))
    assert row[0]["message"] == '{"message": null, "msg": "later", "level": "error"}'
    assert row[1]["message"] == '{"a": 1}' and row[1]["parsed"]


def test_json_lines_that_are_not_objects_count_as_unparsed(lines_of):
    rows = parsed(lines_of({1: [*JSON, *JSON, "[1]", "{broken", '{"a":1} {"b":2}']}))
    assert [r["parsed"] for r in rows] == [True, True, True, True, False, False, False]
    assert rows[4]["level"] is None and rows[4]["message"] is None
    rows = parsed(lines_of({1: [*JSON, '{"a":1},{"b":2}', '{"a":1} x}', '{"a":[{"b":1}],"msg":"x","msg":"y"}']}))
    assert [r["parsed"] for r in rows] == [True, True, False, False, True]
    assert rows[4]["message"] == "y"


def test_logfmt_quotes_and_last_duplicate(lines_of):
    lines = [*LOGFMT, "level=info level=error msg=last ts=2026-03-01T08:00:03Z", 'level=warn msg="" x=1', "only=one"]
    rows = parsed(lines_of({1: lines}))
    assert rows[0]["message"] == 'queue "mail" stuck'
    assert rows[2]["level"] == "error"
    assert rows[3]["message"] == 'level=warn msg="" x=1'
    assert not rows[4]["parsed"]


def test_syslog_level_words_and_impossible_date(lines_of):
    rows = parsed(lines_of({1: [*SYSLOG, "Feb 31 10:00:00 h app: err found"]}))
    assert [r["level"] for r in rows] == ["error", "info", "error"]
    assert rows[0]["ts"] == datetime(2026, 3, 1, 8, 0, 1)
    assert rows[2]["ts"] is None and rows[2]["parsed"]


def test_syslog_extra_fields(lines_of):
    row = parsing.syslog_fields(lines_of({1: SYSLOG})).orderBy("line_no").first()
    assert (row.host, row.process, row.pid) == ("db-2", "postgres", "77")


def test_freeform_hint_and_missing_word_boundary(lines_of):
    rows = parsed(lines_of({1: [*PLAIN, "Information about x", "Traceback (most recent)", "\t!! odd ??"]}))
    assert rows[0]["level"] == "error" and rows[0]["ts"] == datetime(2026, 3, 1, 8, 0, 1, 250000)
    assert (rows[1]["level"], rows[1]["message"], rows[1]["ts"]) == ("error", PLAIN[1], None)
    assert (rows[2]["level"], rows[2]["message"]) == ("info", "rmation about x")
    assert rows[3]["level"] == "debug"
    assert all(r["parsed"] for r in rows)


@pytest.mark.parametrize(
    ("raw", "level"),
    [(" WARN ", "warning"), ("Err", "error"), ("panic", "critical"), ("trace", "debug"), ("loud", None), ("", None)],
)
def test_levels(spark, raw, level):
    assert spark.range(1).select(normalize_level(F.lit(raw))).first()[0] == level


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("2026-07-05 01:02:03,4", datetime(2026, 7, 5, 1, 2, 3, 400000)),
        ("2026-07-05T01:02:03.000004+0530", datetime(2026, 7, 4, 19, 32, 3, 4)),
        ("2026-07-05T01:02:03Z", datetime(2026, 7, 5, 1, 2, 3)),
        ("2026-07-05 01:02:03+00:00", None),
        ("2026-07-05T01:02:03,5", None),
        ("2026-07-05 01:02:03.1234567", None),
        ("2026-02-30 01:02:03", None),
        ("1783213323", None),
    ],
)
def test_timestamps(spark, raw, expected):
    assert spark.range(1).select(parse_timestamp(F.lit(raw))).first()[0] == expected


@pytest.mark.parametrize(
    ("message", "template"),
    [
        ("User 55 from 10.1.2.3:80 failed", "user <n> from <ip> failed"),
        ("user 9 FROM 10.9.9.9 failed", "user <n> from <ip> failed"),
        ("can't start, won't stop", "can<str>t stop"),
        ("took 12ms or 3.5s", "took 12ms or <n>.5s"),
        ("open /var/lib/x.db   now", "open <path> now"),
        ("id 123e4567-e89b-12d3-a456-426614174000 at 2026-01-02 03:04:05", "id <uuid> at <ts>"),
        ('said "no way" to deadbeefdeadbeef', "said <str> to <hex>"),
    ],
)
def test_templates(spark, message, template):
    assert spark.range(1).select(template_of(F.lit(message))).first()[0] == template


def test_iso_rule_set(spark):
    message = F.lit("at 2026-01-02T03:04:05Z sharp")
    compat, fixed = spark.range(1).select(template_of(message), template_of(message, "iso_fixed")).first()
    assert compat != fixed and fixed == "at <ts> sharp"


def test_level_is_part_of_identity(spark):
    a, b = spark.range(1).select(
        fingerprint(F.lit("error"), F.lit("x")), fingerprint(F.lit("warning"), F.lit("x"))
    ).first()
    assert a != b


def test_six_line_file(lines_of):
    lines = [
        "2026-03-01 08:00:01 ERROR payment 17 declined",
        "2026-03-01 08:00:04 INFO started",
        "2026-03-01 08:00:03 ERROR payment 18 declined",
        "",
        "2026-03-01 08:00:02 ERROR payment 19 declined",
        "2026-03-01 08:00:05 WARN pool low",
        "2026-03-01 08:00:06 CRITICAL database gone",
    ]
    rows = parsing.parse_log(lines_of({1: lines}), 2026)
    counters = grouping.run_counters(rows).first()
    assert (counters.total_lines, counters.parsed_lines, counters.error_lines, counters.group_count) == (6, 6, 5, 3)
    groups = grouping.error_groups(rows).orderBy(F.desc("count")).collect()
    top = groups[0]
    assert (top["count"], len(top.sample_lines), top.severity) == (3, 3, "high")
    assert top.sample_lines == [lines[0], lines[2], lines[4]]
    assert top.first_seen == datetime(2026, 3, 1, 8, 0, 1) and top.last_seen == datetime(2026, 3, 1, 8, 0, 3)
    assert {g.severity for g in groups} == {"high", "medium", "critical"}


def test_samples_are_capped_and_whole(lines_of):
    lines = [f"ERROR boom {n} " + "y" * 3000 for n in range(9)]
    group = grouping.error_groups(parsing.parse_log(lines_of({1: lines}), 2026)).first()
    assert group["count"] == 9 and len(group.sample_lines) == 5
    assert group.sample_lines[0] == lines[0]


def test_group_plan_has_no_python_and_limits_samples_before_the_shuffle(lines_of):
    errors = grouping.error_lines(parsing.parse_log(lines_of({1: PLAIN}), 2026))
    plan = grouping.groups_of(errors)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Partial" in plan and "WindowGroupLimit" in plan
    rules = grouping.group_counts(errors)._jdf.queryExecution().executedPlan().toString()
    assert rules.count("<uuid>") == 1


def test_single_quoted_lines_are_no_json(spark, lines_of):
    lines = lines_of({1: ["{'level': 'error', 'message': 'boom'}"], 2: ['{"level": "error", "message": "boom"}']})
    formats = {r["file_id"]: r["format"] for r in parsing.detect_formats(lines).collect()}
    assert formats == {1: "plain", 2: "json"}


def test_long_messages_stay_apart(spark, lines_of):
    lines = lines_of({1: [f"2026-03-01 08:00:01 ERROR {'word ' * 200}{end}" for end in ("left", "right")]})
    groups = grouping.error_groups(parsing.parse_log(lines, 2026)).collect()
    assert len(groups) == 2 and all(len(g["sample_lines"][0]) > 1000 for g in groups)
