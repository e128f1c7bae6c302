"""The registered queries once more, as plain SQL for an independent engine.

Each query is a final SELECT over named parts.  A part may use other parts and
the given tables; ``build`` puts the needed ones into one WITH clause.  The SQL
shares only the fixed values with the Spark side.
"""

from __future__ import annotations

from logspark import fixed

PARTS: dict[str, tuple[list[str], str]] = {}
QUERIES: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


def query(name: str, needs: list[str], sql: str) -> None:
    QUERIES[name] = (needs, sql)


def build(name: str) -> str:
    needs, final = QUERIES[name]
    ordered: list[str] = []

    def visit(part_name: str) -> None:
        for needed in PARTS[part_name][0]:
            visit(needed)
        if part_name not in ordered:
            ordered.append(part_name)

    for needed in needs:
        visit(needed)
    if not ordered:
        return final.strip()
    body = ",\n".join(f"{p} AS MATERIALIZED ({PARTS[p][1].strip()})" for p in ordered)
    text = final.strip()
    return f"WITH {body},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {body}\n{text}"


def all_queries() -> dict[str, str]:
    return {name: build(name) for name in QUERIES}


# --- text helpers -----------------------------------------------------------------


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NEWLINE_SPLIT = q(r"\r\n|\r|\n")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def case_of(x: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} END"


def level_of(x: str) -> str:
    return case_of(
        f"lower({strip(x)})", {**{v: v for v in fixed.LEVELS}, **fixed.LEVEL_ALIASES}
    )


def severity_of(level: str) -> str:
    return case_of(level, fixed.SEVERITY_BY_LEVEL)


def rank_of(severity: str) -> str:
    whens = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(fixed.SEVERITIES))
    return f"CASE {severity} {whens} ELSE {fixed.UNKNOWN_SEVERITY_RANK} END"


def time_of(x: str) -> str:
    text = strip(x)
    return (
        f"CASE WHEN regexp_matches({text}, {q(fixed.TIMESTAMP_SPACED)}) "
        f"THEN try_cast(replace({text}, ',', '.') AS TIMESTAMP) "
        f"WHEN regexp_matches({text}, {q(fixed.TIMESTAMP_ISO)}) "
        f"THEN try_cast({text} AS TIMESTAMP) END"
    )


def template_of(x: str) -> str:
    expr = f"lower({strip(x)})"
    for pattern, mark in fixed.TEMPLATE_RULES:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(mark)}, 'g')"
    return strip(expr)


def lines_of(text: str) -> str:
    """List of lines; a final newline does not start another line."""
    body = f"regexp_replace({text}, '(?:\\r\\n|\\r|\\n)\\z', '')"
    return f"CASE WHEN {text} = '' THEN [] ELSE string_split_regex({body}, {NEWLINE_SPLIT}) END"


def shown_time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# --- derived inputs ----------------------------------------------------------------

part(
    "log_lines",
    [],
    """
WITH e AS (SELECT event_id, user_id, ts, event_type, value,
                  cast(json_extract_string(props, '$.k') AS int) AS k FROM events),
m AS (SELECT user_id AS file_id, event_id, ts,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning'
                  WHEN 'signup' THEN 'critical' WHEN 'view' THEN 'info' ELSE 'debug' END AS lvl,
  CASE k % 6
    WHEN 0 THEN concat('Database connection timeout for user ', cast(user_id AS varchar), ' after ', cast(cast(value AS decimal(18,2)) AS varchar), ' ms')
    WHEN 1 THEN concat('Redis connection pool exhausted at 10.0.', cast(k AS varchar), '.', cast(user_id % 250 AS varchar), ':6379')
    WHEN 2 THEN concat('Out of memory, killing worker ', cast(event_id AS varchar))
    WHEN 3 THEN concat('Slow query took ', cast(cast(value AS decimal(18,2)) AS varchar), ' ms reading ''chunk ', cast(k AS varchar), '''')
    WHEN 4 THEN concat('Upstream returned HTTP 502 for request ', md5(cast(event_id AS varchar)))
    ELSE concat('Disk quota exceeded on /var/data/vol', cast(k AS varchar), '/seg.bin') END AS msg
  FROM e)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS line_no,
  CASE file_id % 4
    WHEN 0 THEN concat('{"timestamp": "', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z", "level": "', lvl, '", "message": "', msg, '"}')
    WHEN 1 THEN concat('time=', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z level=', lvl, ' msg="', msg, '" service=api')
    WHEN 2 THEN concat(strftime(ts, '%b %-d %H:%M:%S'), ' web-1 app[221]: ', lvl, ' ', msg)
    ELSE concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', upper(lvl), ' ', msg) END AS raw
FROM m
""",
)

part(
    "request_log",
    [],
    """
WITH e AS (SELECT event_id, user_id, ts, event_type, value,
                  cast(json_extract_string(props, '$.k') AS int) AS k,
                  md5(cast(event_id AS varchar)) AS h FROM events),
u AS (SELECT *, concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) AS id FROM e)
SELECT event_id, ts,
  CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE k % 5 WHEN 0 THEN concat('/api/v1/analyses/', id)
             WHEN 1 THEN concat('/api/v1/analyses/', id, '/groups')
             WHEN 2 THEN concat('/api/v1/logs/', id, '/chat')
             WHEN 3 THEN '/api/v1/health' ELSE '/metrics' END AS path,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 503 WHEN event_type = 'error' THEN 500
       WHEN k % 10 = 9 THEN 404 WHEN event_type = 'purchase' THEN 202 ELSE 200 END AS status,
  value / 1000 AS duration_s,
  concat('10.0.0.', cast(user_id % 250 AS varchar)) AS client_ip
FROM u
""",
)

part(
    "long_log_lines",
    [],
    """
WITH r AS (
  SELECT l_suppkey % 4 AS file_id,
    concat(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'),
      CASE l_returnflag WHEN 'R' THEN ' ERROR ' WHEN 'A' THEN ' WARNING ' ELSE ' INFO ' END,
      'shipment of order ', cast(l_orderkey AS varchar), ' part ', cast(l_partkey AS varchar),
      ' delayed ', cast(cast(l_quantity AS int) AS varchar), ' h') AS raw
  FROM lineitem)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY raw) AS line_no, raw FROM r
""",
)

# --- detection, parsing, grouping ------------------------------------------------------

_SYSLOG_FIELDS = strings(["month", "day", "clock", "host", "process", "pid", "message"])
_PLAIN_FIELDS = strings(["ts", "level", "message"])

part(
    "formats",
    ["log_lines"],
    f"""
WITH head AS (SELECT file_id, {strip('raw')} AS line FROM log_lines
              WHERE {strip('raw')} <> ''),
keyed AS (SELECT *, regexp_extract_all(line, {q(fixed.LOGFMT_PAIR)}, 1) AS keys FROM head),
scored AS (SELECT file_id,
  avg(CASE WHEN line[1] = '{{' AND json_valid(line) THEN 1.0 ELSE 0.0 END) AS json_score,
  avg(CASE WHEN len(list_distinct(keys)) >= 2 AND list_has_any(keys, {strings(fixed.LOGFMT_KNOWN_KEYS)})
      THEN 1.0 ELSE 0.0 END) AS logfmt_score,
  avg(CASE WHEN regexp_matches(line, {q(fixed.SYSLOG_LINE)}) THEN 1.0 ELSE 0.0 END) AS syslog_score
  FROM keyed GROUP BY file_id)
SELECT file_id,
  CASE WHEN greatest(json_score, logfmt_score, syslog_score) < {fixed.MIN_FORMAT_SCORE} THEN 'plain'
       WHEN json_score >= logfmt_score AND json_score >= syslog_score THEN 'json'
       WHEN logfmt_score >= syslog_score THEN 'logfmt' ELSE 'syslog' END AS format,
  round(json_score, 4) AS json_score, round(logfmt_score, 4) AS logfmt_score,
  round(syslog_score, 4) AS syslog_score
FROM scored
""",
)


def _first_json(keys: list[str]) -> str:
    paths = [q(f'$."{k}"') for k in keys]
    whens = " ".join(f"WHEN json_exists(line, {p}) THEN json_extract_string(line, {p})" for p in paths)
    return f"CASE {whens} END"


def _last_pair(key: str) -> str:
    return f"list_filter(pairs, lambda x: x[1] = {q(key)})[-1][2]"


def _unquoted(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, '\"') AND ends_with({x}, '\"') "
        f"THEN replace(substr({x}, 2, length({x}) - 2), '\\\"', '\"') ELSE {x} END"
    )


part(
    "parsed",
    ["log_lines", "formats"],
    f"""
WITH l AS (SELECT l.file_id, l.line_no, l.raw, {strip('l.raw')} AS line, coalesce(f.format, 'plain') AS format
           FROM log_lines l LEFT JOIN formats f USING (file_id) WHERE {strip('l.raw')} <> ''),
j AS (SELECT file_id, line_no, format, json_valid(line) AND line[1] = '{{' AS parsed,
        {level_of(_first_json(fixed.JSON_LEVEL_KEYS))} AS level,
        {time_of(_first_json(fixed.JSON_TIME_KEYS))} AS ts,
        coalesce({_first_json(fixed.JSON_MESSAGE_KEYS)}, line) AS message, line AS text
      FROM l WHERE format = 'json'),
k0 AS (SELECT file_id, line_no, format, line,
        regexp_extract_all(line, {q(fixed.LOGFMT_PAIR)}, 1) AS keys,
        list_zip(regexp_extract_all(line, {q(fixed.LOGFMT_PAIR)}, 1),
                 regexp_extract_all(line, {q(fixed.LOGFMT_PAIR)}, 2)) AS pairs
       FROM l WHERE format = 'logfmt'),
k1 AS (SELECT file_id, line_no, format, line,
        len(list_distinct(keys)) >= 2 AND list_has_any(keys, {strings(fixed.LOGFMT_KNOWN_KEYS)}) AS parsed,
        {_last_pair('level')} AS lv, coalesce({_last_pair('time')}, {_last_pair('ts')}) AS tm,
        coalesce({_last_pair('msg')}, {_last_pair('message')}) AS ms FROM k0),
k AS (SELECT file_id, line_no, format, parsed, {level_of(_unquoted('lv'))} AS level,
        {time_of(_unquoted('tm'))} AS ts, coalesce(nullif({_unquoted('ms')}, ''), line) AS message,
        line AS text FROM k1),
s0 AS (SELECT file_id, line_no, format, raw, regexp_matches(line, {q(fixed.SYSLOG_LINE)}) AS parsed,
        regexp_extract(line, {q(fixed.SYSLOG_LINE)}, {_SYSLOG_FIELDS}) AS g FROM l WHERE format = 'syslog'),
s1 AS (SELECT *, lower(regexp_extract(g.message, {q(fixed.SYSLOG_LEVEL_WORD)}, 1)) AS word FROM s0),
s AS (SELECT file_id, line_no, format, parsed,
        CASE WHEN word = '' THEN 'info' ELSE coalesce({level_of('word')}, 'error') END AS level,
        try_strptime('2024 ' || g.month || ' ' || g.day || ' ' || g.clock, '%Y %b %d %H:%M:%S') AS ts,
        g.message AS message, raw AS text FROM s1),
p0 AS (SELECT file_id, line_no, format, raw, regexp_extract(line, {q(fixed.PLAIN_LINE)}, {_PLAIN_FIELDS}) AS g
       FROM l WHERE format = 'plain'),
p1 AS (SELECT *, coalesce(nullif(g.message, ''), raw) AS msg FROM p0),
p AS (SELECT file_id, line_no, format, true AS parsed,
        coalesce({level_of('g.level')},
                 CASE WHEN regexp_matches(msg, {q(fixed.PLAIN_ERROR_HINT)}) THEN 'error' END) AS level,
        {time_of('g.ts')} AS ts, msg AS message, raw AS text FROM p1),
a AS (SELECT * FROM j UNION ALL SELECT * FROM k UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p)
SELECT file_id, line_no, format, parsed, CASE WHEN parsed THEN level END AS level,
  CASE WHEN parsed THEN ts END AS ts, CASE WHEN parsed THEN message END AS message,
  CASE WHEN parsed THEN text END AS text FROM a
""",
)

part(
    "errors",
    ["parsed"],
    f"""
SELECT file_id, line_no, format, level, ts, text, {template_of('message')} AS template
FROM parsed WHERE level IN ('warning', 'error', 'critical')
""",
)

part(
    "groups",
    ["errors"],
    f"""
SELECT file_id, file_id % 5 AS user_id, format, sha256(level || '|' || template) AS fingerprint,
  sha256(cast(file_id AS varchar) || '|' || sha256(level || '|' || template)) AS group_id,
  level, template, {severity_of('level')} AS severity, count(*) AS n,
  min(ts) AS first_seen, max(ts) AS last_seen,
  list(text ORDER BY line_no)[1:{fixed.SAMPLES_PER_GROUP}] AS samples
FROM errors GROUP BY file_id, format, level, template
""",
)

query(
    "line_scan_counts",
    [],
    f"""
WITH l AS (SELECT doc_id, unnest({lines_of('text')}) AS line FROM documents)
SELECT d.doc_id AS file_id, count(l.line) AS physical_lines,
  count(CASE WHEN {strip('l.line')} <> '' THEN 1 END) AS total_lines
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.doc_id
""",
)

query("format_detection", ["formats"], "SELECT * FROM formats")

for _fmt in fixed.FORMATS:
    query(
        f"parse_{_fmt}_lines",
        ["parsed"],
        f"""
SELECT file_id, line_no, parsed, level, {shown_time('ts')} AS ts, message
FROM parsed WHERE format = '{_fmt}'
""",
    )

query(
    "message_templates",
    ["errors"],
    "SELECT level, template, sha256(level || '|' || template) AS fingerprint, count(*) AS n "
    "FROM errors GROUP BY level, template",
)

query(
    "error_groups",
    ["groups"],
    f"""
SELECT file_id, fingerprint, level, template, severity, n AS "count",
  {shown_time('first_seen')} AS first_seen, {shown_time('last_seen')} AS last_seen,
  len(samples) AS samples, sha256(array_to_string(samples, chr(10))) AS samples_sha
FROM groups
""",
)

query(
    "group_samples",
    ["groups"],
    "SELECT file_id, level, template, array_to_string(samples, chr(10)) AS sample_lines FROM groups",
)

part(
    "counters",
    ["parsed", "errors"],
    """
SELECT p.file_id, count(*) AS total_lines, count(CASE WHEN parsed THEN 1 END) AS parsed_lines,
  count(CASE WHEN p.level IN ('warning', 'error', 'critical') THEN 1 END) AS error_lines,
  count(DISTINCT CASE WHEN e.template IS NOT NULL THEN e.level || '|' || e.template END) AS group_count
FROM parsed p LEFT JOIN errors e USING (file_id, line_no) GROUP BY p.file_id
""",
)

query("run_counters", ["counters"], "SELECT * FROM counters")

query(
    "long_file_groups",
    ["long_log_lines"],
    """
WITH l AS (SELECT *, split_part(raw, ' ', 3) AS word, substr(raw, 1, 19) AS stamp FROM long_log_lines)
SELECT file_id, lower(word) AS level, 'shipment of order <n> part <n> delayed <n> h' AS template, count(*) AS "count",
  min(stamp) AS first_seen, max(stamp) AS last_seen,
  array_to_string(list(raw ORDER BY line_no)[1:5], chr(10)) AS sample_lines
FROM l WHERE word IN ('ERROR', 'WARNING') GROUP BY file_id, word
""",
)
