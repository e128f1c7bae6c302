"""SQL oracles over groups: pages, enrichment, commands, incidents, reports."""

from __future__ import annotations

from logspark import fixed
from logspark.plans.group_queries import OFFERED_COMMANDS
from logspark.plans.incident_queries import GENERATED_AT
from logspark.plans.oracle import (
    NEWLINE_SPLIT,
    QUERIES,
    case_of,
    part,
    q,
    query,
    rank_of,
    severity_of,
    shown_time,
    strings,
    strip,
    time_of,
)

# --- ingest ------------------------------------------------------------------------------

query(
    "file_manifest",
    [],
    f"""
SELECT doc_id AS file_id, 'paste-' || cast(doc_id AS varchar) || '.log' AS filename, '.log' AS suffix,
  octet_length(encode(text)) AS size_bytes, sha256(text) AS content_hash, 'paste' AS source,
  CASE WHEN octet_length(encode(text)) > {fixed.MAX_PASTE_BYTES} THEN 'too large'
       WHEN {strip('text')} = '' THEN 'empty' END AS reason
FROM documents
""",
)

query(
    "duplicate_uploads",
    [],
    """
SELECT doc_id AS file_id, lang AS user_id,
  count(*) OVER (PARTITION BY lang, sha256(text)) AS copies,
  min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first_file,
  min(doc_id) OVER (PARTITION BY lang, sha256(text)) <> doc_id AS is_duplicate
FROM documents
""",
)

_SPACED = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_MICROS = "strftime(ts, '%f')"
query(
    "timestamp_cascade",
    [],
    f"""
WITH r AS (SELECT event_id, CASE event_id % 11
  WHEN 0 THEN {_SPACED} || ',' || substr({_MICROS}, 1, 3)
  WHEN 1 THEN {_SPACED} || '.' || {_MICROS}
  WHEN 2 THEN ' ' || {_SPACED}
  WHEN 3 THEN {_ISO} || '.' || {_MICROS} || '+05:30'
  WHEN 4 THEN {_ISO} || 'Z'
  WHEN 5 THEN {_ISO} || '-0330'
  WHEN 6 THEN {_ISO} || '.' || substr({_MICROS}, 1, 2)
  WHEN 7 THEN {_ISO}
  WHEN 8 THEN {_SPACED} || '+02:00'
  WHEN 9 THEN {_ISO} || ',' || {_MICROS}
  ELSE cast(epoch_us(ts) // 1000000 AS varchar) END AS text FROM events)
SELECT event_id, text, CASE event_id % 11
  WHEN 3 THEN epoch_us(try_strptime(substr(text, 1, 26), '%Y-%m-%dT%H:%M:%S.%f')) - 19800000000
  WHEN 5 THEN epoch_us(try_strptime(substr(text, 1, 19), '%Y-%m-%dT%H:%M:%S')) + 12600000000
  ELSE epoch_us({time_of('text')}) END AS micros
FROM r
""",
)

# --- pages ---------------------------------------------------------------------------------

query(
    "severity_breakdown",
    ["counters", "groups"],
    """
WITH s AS (SELECT file_id, severity, count(*) AS n FROM groups GROUP BY ALL),
t AS (SELECT file_id, string_agg(cast(n AS varchar) || ' ' || severity, ', ' ORDER BY severity) AS spread
      FROM s GROUP BY file_id)
SELECT c.file_id, coalesce(t.spread, 'none') AS severity_spread FROM counters c LEFT JOIN t USING (file_id)
""",
)

query(
    "top_groups_page",
    ["groups", "insights"],
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, fingerprint) AS position,
                  count(*) OVER (PARTITION BY file_id) AS total FROM groups)
SELECT r.file_id, cast(position AS int) AS position, total, r.group_id, r.n AS "count", r.template, i.error_type
FROM r LEFT JOIN insights i ON i.group_id = r.group_id WHERE position BETWEEN 6 AND 10
""",
)

part(
    "runs",
    ["counters", "parsed"],
    """
SELECT c.*, t.created_at, c.file_id % 5 AS user_id, 'app-' || cast(c.file_id AS varchar) || '.log' AS filename,
  CASE WHEN c.file_id % 17 = 16 THEN 'failed' ELSE 'completed' END AS status
FROM counters c JOIN (SELECT file_id, max(ts) AS created_at FROM parsed GROUP BY file_id) t USING (file_id)
""",
)

query(
    "run_history_page",
    ["runs"],
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) AS position,
                  count(*) OVER (PARTITION BY user_id) AS total FROM runs)
SELECT user_id, position, total, file_id, filename, status, {shown_time('created_at')} AS created_at,
  total_lines, error_lines
FROM r WHERE position BETWEEN 11 AND 20
""",
)

# --- classification ------------------------------------------------------------------------

_RULES = [*fixed.CLASSIFIER_RULES, fixed.CLASSIFIER_FALLBACK]


def _hits(rule: dict) -> str:
    return " + ".join(f"cast(contains(haystack, {q(k)}) AS int)" for k in rule["keywords"])


def _by_rule(value) -> str:
    return "CASE rule " + " ".join(f"WHEN {i} THEN {value(r)}" for i, r in enumerate(_RULES)) + " END"


part(
    "classified",
    ["groups"],
    f"""
WITH h AS (SELECT *, lower(template || ' ' || array_to_string(samples, ' ')) AS haystack FROM groups),
s AS (SELECT *, {', '.join(f'{_hits(r)} AS h{i}' for i, r in enumerate(fixed.CLASSIFIER_RULES))} FROM h),
c AS (SELECT *, CASE WHEN greatest(h0, h1, h2) < {fixed.CLASSIFIER_MIN_HITS} THEN 3
        WHEN h0 >= h1 AND h0 >= h2 THEN 0 WHEN h1 >= h2 THEN 1 ELSE 2 END AS rule FROM s)
SELECT *, {_by_rule(lambda r: q(r['error_type']))} AS error_type,
  coalesce({_by_rule(lambda r: q(r['severity']) if r['severity'] else 'NULL')}, {severity_of('level')}, 'low') AS insight_severity,
  {_by_rule(lambda r: q(r['root_cause']))} AS root_cause,
  {_by_rule(lambda r: q('; '.join(r['possible_reasons'])))} AS reasons,
  'This group occurred ' || cast(n AS varchar) || ' time(s). ' || {_by_rule(lambda r: q(r['root_cause']))}
    || ' ' || {q(fixed.EXPLANATION_TAIL)} AS explanation,
  {_by_rule(lambda r: q(r['suggested_fix']))} AS suggested_fix,
  {_by_rule(lambda r: strings(r['recommended_commands']) + '::varchar[]')} AS offered,
  cast({_by_rule(lambda r: str(r['confidence']))} AS double) AS confidence
FROM c
""",
)

query(
    "classify_groups",
    ["classified"],
    """
SELECT group_id, error_type, insight_severity AS severity, root_cause, reasons, explanation,
  array_to_string(offered, '; ') AS commands, confidence FROM classified
""",
)

query(
    "insight_cache",
    ["classified"],
    f"""
WITH early AS (SELECT *, row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY first_seen DESC, group_id) AS r
               FROM classified WHERE first_seen < TIMESTAMP '2024-01-16')
SELECT g.group_id, e.group_id IS NOT NULL AS from_cache, e.explanation,
  CASE WHEN e.group_id IS NOT NULL THEN {q(fixed.PROMPT_VERSION)} END AS prompt_version
FROM groups g LEFT JOIN early e ON e.user_id = g.user_id AND e.fingerprint = g.fingerprint AND e.r = 1
WHERE g.first_seen >= TIMESTAMP '2024-01-16'
""".replace("FROM groups g", "FROM classified g"),
)

QUERIES["stored_insight_cache"] = QUERIES["insight_cache"]


def safe(command: str) -> str:
    text = strip(command)
    listed = " OR ".join(f"regexp_matches({text}, {q(p)})" for p in fixed.SAFE_COMMAND_PATTERNS)
    return (
        f"({text} <> '' AND length({text}) <= {fixed.COMMAND_CHARS} "
        f"AND NOT regexp_matches({text}, {q(fixed.SHELL_METACHARACTERS)}) AND ({listed}))"
    )


def kept(commands: str) -> str:
    return f"list_transform(list_filter({commands}, lambda c: {safe('c')}), lambda c: {strip('c')})"


part(
    "insights",
    ["classified"],
    f"""
WITH top AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, fingerprint) AS group_rank FROM classified),
scored AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY file_id) = 1)
SELECT t.group_id, t.file_id, s.group_id <> t.group_id AS from_cache, s.error_type, s.insight_severity, s.root_cause,
  s.explanation, s.suggested_fix, {kept('s.offered')} AS commands,
  s.group_id AS scored_group FROM top t JOIN scored s ON s.user_id = t.user_id AND s.fingerprint = t.fingerprint
""",
)

part(
    "enriched",
    ["groups", "insights"],
    """
SELECT g.* EXCLUDE (severity), coalesce(i.insight_severity, g.severity) AS severity, i.from_cache, i.error_type,
  i.root_cause, i.explanation, i.suggested_fix, i.commands
FROM groups g LEFT JOIN insights i ON i.group_id = g.group_id
""",
)

query(
    "enriched_groups",
    ["enriched"],
    """
SELECT group_id, file_id, severity, from_cache, error_type, explanation,
  array_to_string(commands, '; ') AS commands FROM enriched
""",
)


def _fence(lines: str) -> str:
    scrubbed = (
        f"regexp_replace(x, {q(fixed.FENCE_LOOKALIKE)}, {q(fixed.FENCE_REPLACEMENT)}, 'g')"
    )
    return (
        f"{q(fixed.FENCE_OPEN)} || chr(10) || array_to_string(list_transform({lines}, lambda x: {scrubbed}), chr(10)) "
        f"|| chr(10) || {q(fixed.FENCE_CLOSE)}"
    )


part(
    "prompts",
    ["groups"],
    f"""
SELECT group_id, 'Error group (detected format: ' || format || ')' || chr(10) || 'Level: ' || level || chr(10)
  || 'Occurrences: ' || cast(n AS varchar) || chr(10) || 'Normalized template: ' || template || chr(10) || chr(10)
  || 'Sample raw lines:' || chr(10) || {_fence('samples')} AS prompt
FROM groups
""",
)

query(
    "scoring_requests",
    ["prompts"],
    f"""
SELECT group_id, {q(fixed.PROMPT_VERSION)} AS prompt_version, length(prompt) AS chars, sha256(prompt) AS prompt_sha
FROM prompts
""",
)

query(
    "token_cost",
    ["insights", "prompts"],
    r"""
SELECT i.file_id, 'by-word' AS model, count(*) AS insights,
  cast(sum(CASE WHEN from_cache THEN 0 ELSE len(string_split_regex(p.prompt, '\s+')) END) AS bigint) AS prompt_tokens,
  cast(sum(CASE WHEN from_cache THEN 0 ELSE len(string_split(i.explanation, ' ')) END) AS bigint) AS completion_tokens,
  round(avg(cast(from_cache AS int)), 4) AS cached_share
FROM insights i JOIN prompts p ON p.group_id = i.group_id GROUP BY i.file_id
""",
)

_MISSING = " ".join(
    f"CASE WHEN json_type(t, '$.{name}') IS NULL THEN '{name}: missing' END,"
    for name in (
        "error_type", "severity", "root_cause", "possible_reasons", "explanation", "suggested_fix", "confidence",
    )
)
query(
    "insight_validation",
    ["groups"],
    f"""
WITH d AS (SELECT group_id, severity, n, substr(fingerprint, 1, 1) AS digit FROM groups),
t0 AS (SELECT group_id, digit, CASE WHEN digit = '7' THEN '[1]' ELSE
  '{{"error_type": "' || CASE WHEN digit = '5' THEN repeat('x', 65) ELSE 'Application Error' END
  || '", "severity": "' || CASE WHEN digit = '0' THEN 'urgent' ELSE severity END || '", '
  || CASE WHEN digit = '2' THEN '' ELSE '"root_cause": "seen ' || cast(n AS varchar) || ' times", ' END
  || '"possible_reasons": ' || CASE WHEN digit = '3' THEN '["a","a","a","a","a","a","a"]' ELSE '["a","a"]' END
  || ', "explanation": "text", "suggested_fix": "text", "recommended_commands": '
  || CASE WHEN digit = '6' THEN '["df -h","df -h","df -h","df -h","df -h","df -h","df -h","df -h","df -h"]'
     ELSE '["kubectl get pods", "rm -rf /", " free -m "]' END
  || ', "confidence": ' || CASE WHEN digit = '1' THEN '1.5' ELSE '0.5' END
  || CASE WHEN digit = '4' THEN '' ELSE '}}' END END AS t FROM d),
ok AS (SELECT group_id, t FROM t0 WHERE json_valid(t) AND substr(t, 1, 1) = '{{'),
v AS (SELECT group_id, list_filter([{_MISSING}
  CASE WHEN length(json_extract_string(t, '$.error_type')) > {fixed.ERROR_TYPE_CHARS} THEN 'error_type: too long' END,
  CASE WHEN json_extract_string(t, '$.severity') NOT IN ('critical','high','medium','low') THEN 'severity: not allowed' END,
  CASE WHEN json_array_length(t, '$.possible_reasons') > {fixed.MAX_REASONS} THEN 'possible_reasons: too many' END,
  CASE WHEN json_array_length(t, '$.recommended_commands') > {fixed.MAX_COMMANDS} THEN 'recommended_commands: too many' END,
  CASE WHEN cast(json_extract(t, '$.confidence') AS double) NOT BETWEEN 0 AND 1 THEN 'confidence: out of range' END
  ], lambda x: x IS NOT NULL) AS problems,
  from_json(json_extract(t, '$.recommended_commands'), '["VARCHAR"]') AS offered FROM ok)
SELECT t0.group_id, coalesce(len(problems) = 0, false) AS valid,
  coalesce(array_to_string(problems, '; '), 'payload: not an object') AS problems,
  array_to_string({kept('offered')}, '; ') AS commands
FROM t0 LEFT JOIN v ON v.group_id = t0.group_id
""",
)

# --- commands --------------------------------------------------------------------------------

_SUGGESTED = {**fixed.COMMANDS_BY_ERROR_TYPE, "__default__": fixed.DEFAULT_COMMANDS}
_CATALOG = {row[0]: row for row in fixed.COMMAND_CATALOG}


def _rendered(template: str) -> str:
    for name, value in fixed.PARAM_DEFAULTS.items():
        template = template.replace("{" + name + "}", value)
    return template


_SUGGESTION_ROWS = ", ".join(
    f"({q(kind)}, {pos}, {q(_rendered(_CATALOG[tid][2]))}, {q(_CATALOG[tid][3])}, {q(_CATALOG[tid][1])})"
    for kind, ids in _SUGGESTED.items()
    for pos, tid in enumerate(ids)
)
part(
    "suggested",
    [],
    f"SELECT * FROM (VALUES {_SUGGESTION_ROWS}) AS t(list_type, pos, command, description, domain)",
)

query(
    "command_suggestions",
    ["enriched", "suggested"],
    f"""
SELECT e.group_id, e.error_type, s.pos, s.command, s.description, s.domain
FROM enriched e JOIN suggested s ON s.list_type =
  CASE WHEN coalesce(e.error_type, 'Application Error') IN ({', '.join(q(t) for t in fixed.COMMANDS_BY_ERROR_TYPE)})
       THEN coalesce(e.error_type, 'Application Error') ELSE '__default__' END
""",
)

_VALUES = {
    "namespace": "CASE WHEN event_id % 7 = 0 THEN 'prod; rm -rf /' ELSE 'team-' || k END",
    "pod": "CASE WHEN event_id % 5 = 0 THEN 'api-1' || chr(10) ELSE 'api-' || cast(event_id AS varchar) END",
    "service": "'worker@' || k || '.service'",
    "host": "CASE WHEN event_id % 3 = 0 THEN '$(id)' ELSE 'db-' || k || '.internal' END",
    "port": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(cast(k AS int) * 1999 AS varchar) END",
    "log_group": "'/aws/app/' || k",
}


def _command_case(row: tuple) -> str:
    tid, _, template, _, names = row
    if not names:
        return f"WHEN {q(tid)} THEN struct_pack(command := {q(template)}, reason := NULL::varchar)"
    bad = "list_filter([" + ", ".join(
        f"CASE WHEN NOT regexp_full_match(coalesce(p_{n}, ''), {q(fixed.PARAM_PATTERNS[n])}) THEN {q(n)} END" for n in names
    ) + "], lambda x: x IS NOT NULL)"
    text = q(template)
    for n in names:
        text = f"replace({text}, '{{{n}}}', coalesce(p_{n}, ''))"
    return (
        f"WHEN {q(tid)} THEN struct_pack(command := CASE WHEN len({bad}) = 0 THEN {text} END, "
        f"reason := CASE WHEN len({bad}) > 0 THEN 'invalid ' || array_to_string({bad}, ', ') END)"
    )


_IDS = [row[0] for row in fixed.COMMAND_CATALOG] + ["drop_tables"]
query(
    "command_params_check",
    [],
    f"""
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
p AS (SELECT event_id, {strings(_IDS)}[event_id % {len(_IDS)} + 1] AS template_id,
  {', '.join(f'{v} AS p_{n}' for n, v in _VALUES.items())} FROM e),
r AS (SELECT event_id, template_id, CASE template_id {' '.join(_command_case(r) for r in fixed.COMMAND_CATALOG)}
  ELSE struct_pack(command := NULL::varchar, reason := 'unknown template') END AS r FROM p)
SELECT event_id, template_id, r.command AS command, r.reason AS reason FROM r
""",
)

query(
    "safe_commands",
    ["groups"],
    f"""
WITH o AS (SELECT group_id, list_transform({strings(OFFERED_COMMANDS)}, lambda c: c || ' ' || substr(fingerprint, 1, 8)) AS offered
           FROM groups),
k AS (SELECT group_id, {kept('offered')} AS kept FROM o)
SELECT group_id, len(kept) AS kept, array_to_string(kept, '; ') AS commands FROM k
""",
)

# --- conversations ------------------------------------------------------------------------------

query(
    "last_turns",
    [],
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, text, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int) AS position
FROM r WHERE back <= {fixed.HISTORY_TURNS}
""",
)
query("conversation_history", [], "SELECT * FROM conversations ORDER BY conv_id, turn")
query(
    "checked_questions",
    [],
    f"""
SELECT conv_id, turn, length(text) AS chars,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty question'
       WHEN length(text) > {fixed.QUESTION_CHARS} THEN 'question too long' END AS reason
FROM conversations
""",
)

# --- incidents ---------------------------------------------------------------------------------

part(
    "timeline",
    ["enriched"],
    f"""
SELECT file_id, group_id, fingerprint, coalesce(nullif(error_type, ''), template) AS label, template, severity, n, first_seen, last_seen,
  row_number() OVER (PARTITION BY file_id ORDER BY first_seen ASC NULLS LAST, {rank_of('severity')}, n DESC, fingerprint) AS pos
FROM enriched
""",
)

query(
    "incident_timeline",
    ["timeline"],
    f"""
SELECT file_id, group_id, label, severity, n AS "count", {shown_time('first_seen')} AS first_seen,
  {shown_time('last_seen')} AS last_seen, pos = 1 AS is_first_failure FROM timeline
""",
)

part(
    "checked",
    ["runs", "timeline"],
    f"""
WITH r AS (SELECT file_id FROM runs WHERE status = 'completed'),
a AS (SELECT file_id, count(*) AS event_count, list(label ORDER BY pos)[1:{fixed.PLAN_SUBJECTS}] AS plan,
        first(n ORDER BY pos) AS first_n FROM timeline GROUP BY file_id),
j AS (SELECT r.file_id, coalesce(a.event_count, 0) AS event_count, coalesce(a.plan, []::varchar[]) AS plan, a.first_n
      FROM r LEFT JOIN a USING (file_id))
SELECT file_id, event_count, plan,
  CASE WHEN event_count = 0 THEN []::varchar[]
    WHEN event_count = 1 THEN ['First observed failure: ' || plan[1] || ' (' || cast(first_n AS varchar) || '×).']
    ELSE ['First observed failure: ' || plan[1] || ' (' || cast(first_n AS varchar) || '×).',
          'Likely downstream effects, in order: ' || array_to_string(plan[2:5], ' → ') || '.'] END AS findings,
  CASE WHEN event_count = 0 THEN {q(fixed.NO_ORDERING)}
    WHEN event_count > 1 THEN plan[1] || ' was the trigger; the remaining errors are cascade effects.'
    ELSE plan[1] || ' is an isolated failure.' END AS hypothesis,
  event_count > 1 AS verified,
  cast(CASE WHEN event_count > 1 THEN 0.85 WHEN event_count = 1 THEN 0.6 ELSE 0.4 END AS double) AS confidence,
  CASE WHEN event_count > 1 THEN {q(fixed.NOTE_VERIFIED)} ELSE {q(fixed.NOTE_UNVERIFIED)} END AS note
FROM j
""",
)

query(
    "investigation",
    ["checked"],
    """
SELECT file_id, event_count, array_to_string(plan, ' | ') AS plan, array_to_string(findings, ' ') AS findings,
  verified, confidence, hypothesis || ' ' || note AS conclusion FROM checked
""",
)

query(
    "investigation_trace",
    ["checked"],
    """
SELECT file_id, cast(0 AS bigint) AS seq, 'planner' AS agent, 'plan' AS action,
  'event_count=' || cast(event_count AS varchar) || '; questions=' || cast(to_json(plan) AS varchar) AS content FROM checked
UNION ALL
SELECT file_id, 1, 'investigator', 'hypothesis',
  'findings=' || cast(to_json(findings) AS varchar) || '; hypothesis=' || hypothesis FROM checked
UNION ALL
SELECT file_id, 2, 'verifier', 'verify',
  'confidence=' || cast(confidence AS varchar) || '; note=' || note || '; verified=' || cast(verified AS varchar) FROM checked
""",
)

_NL = "chr(10)"
part(
    "reports",
    ["runs", "enriched", "suggested"],
    f"""
WITH r AS (SELECT * FROM runs WHERE status = 'completed'),
g AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, fingerprint) AS rk FROM enriched),
w AS (SELECT file_id, min({rank_of('severity')}) AS worst FROM g GROUP BY file_id),
sv AS (SELECT file_id, severity, count(*) AS c FROM g GROUP BY ALL),
sp AS (SELECT file_id, string_agg(cast(c AS varchar) || ' ' || severity, ', ' ORDER BY severity) AS spread FROM sv GROUP BY file_id),
cl AS (SELECT list_type, string_agg(command || '  # ' || description, {_NL} ORDER BY pos) AS cmds FROM suggested GROUP BY list_type),
f AS (SELECT g.file_id, g.rk,
  '### ' || cast(rk AS varchar) || '. ' || coalesce(error_type, template) || ' — ' || severity || ' (' || cast(n AS varchar) || '×)' || {_NL} || {_NL}
  || CASE WHEN error_type IS NULL THEN '_No AI insight available for this group._' || {_NL} || {_NL}
     ELSE '**Root cause:** ' || root_cause || {_NL} || {_NL} || '**Explanation:** ' || explanation || {_NL} || {_NL}
       || '**Suggested fix:** ' || suggested_fix || {_NL} || {_NL}
       || '**Diagnostic commands (read-only):**' || {_NL} || {_NL} || '```bash' || {_NL} || cl.cmds || {_NL} || '```' || {_NL} || {_NL} END
  || '<details><summary>Sample lines</summary>' || {_NL} || {_NL} || '```' || {_NL}
  || array_to_string(samples[1:3], {_NL}) || {_NL} || '```' || {_NL} || {_NL} || '</details>' || {_NL} || {_NL} AS txt
  FROM g LEFT JOIN cl ON cl.list_type = CASE WHEN error_type IS NULL THEN NULL
     WHEN error_type IN ({', '.join(q(t) for t in fixed.COMMANDS_BY_ERROR_TYPE)}) THEN error_type ELSE '__default__' END),
fa AS (SELECT file_id, string_agg(txt, '' ORDER BY rk) AS findings FROM f GROUP BY file_id),
tp AS (SELECT file_id, string_agg('- Address **' || error_type || '**: ' || suggested_fix, {_NL} ORDER BY rk) AS tips
       FROM g WHERE rk <= 3 AND error_type IS NOT NULL GROUP BY file_id),
t AS (SELECT r.*, w.worst, sp.spread, fa.findings, tp.tips, top.error_type, top.root_cause, top.template, top.n,
   CASE WHEN w.worst IS NULL THEN 'Incident report — ' || filename || ' (no errors detected)'
     ELSE 'Incident report — ' || ['Critical','High','Medium','Low'][w.worst + 1] || ': ' || filename END AS title
  FROM r LEFT JOIN w USING (file_id) LEFT JOIN sp USING (file_id) LEFT JOIN fa USING (file_id) LEFT JOIN tp USING (file_id)
  LEFT JOIN (SELECT * FROM g WHERE rk = 1) top USING (file_id))
SELECT sha256('report|' || cast(file_id AS varchar)) AS report_id, file_id, title,
  '# ' || title || {_NL} || {_NL} || '*Generated {GENERATED_AT} · source `' || filename || '` · ' || format('{{:,}}', total_lines)
  || ' lines, ' || format('{{:,}}', error_lines) || ' errors, ' || cast(group_count AS varchar) || ' distinct groups.*' || {_NL} || {_NL}
  || '## Summary' || {_NL} || {_NL}
  || CASE WHEN n IS NULL THEN {q(fixed.REPORT_SUMMARY_CLEAN)}
     WHEN error_type IS NOT NULL THEN 'The dominant issue is **' || error_type || '** (' || cast(n AS varchar) || ' occurrences): ' || root_cause
     ELSE 'The most frequent issue occurred ' || cast(n AS varchar) || ' times: `' || template || '`.' END
  || {_NL} || {_NL} || '## Impact' || {_NL} || {_NL} || '- **' || format('{{:,}}', error_lines) || '** error-level lines across **'
  || cast(group_count AS varchar) || '** distinct problems.' || {_NL} || '- Severity spread: ' || coalesce(spread, 'none') || '.' || {_NL} || {_NL}
  || '## Findings' || {_NL} || {_NL} || coalesce(findings, '') || '## Prevention' || {_NL} || {_NL}
  || coalesce(tips, {q(fixed.REPORT_TIP_DEFAULT)}) || {_NL} AS markdown
FROM t
""",
)
query("incident_reports", ["reports"], "SELECT * FROM reports")
query("stored_reports", ["reports"], "SELECT file_id, md5(markdown) AS markdown_md5 FROM reports")
query("exported_reports", ["reports"], "SELECT file_id, md5(markdown || chr(10)) AS markdown_md5 FROM reports")
query(
    "uploaded_manifest",
    ["log_lines"],
    """
WITH t AS (SELECT file_id, string_agg(raw || chr(10), '' ORDER BY line_no) AS text FROM log_lines GROUP BY file_id
           UNION ALL SELECT i, '' FROM (VALUES (-1), (-2)) AS e(i))
SELECT cast(file_id AS bigint) AS file_id, '.txt' AS suffix, octet_length(encode(text)) AS size_bytes, sha256(text) AS content_hash, 'upload' AS source,
  CASE WHEN text = '' THEN 'empty' END AS reason FROM t
""",
)
query(
    "stored_trace",
    ["checked"],
    """
SELECT file_id, cast(0 AS bigint) AS seq, 'planner' AS agent, 'plan' AS action, cast(2 AS bigint) AS entries FROM checked
UNION ALL SELECT file_id, 1, 'investigator', 'hypothesis', 2 FROM checked
UNION ALL SELECT file_id, 2, 'verifier', 'verify', 3 FROM checked
""",
)
for _name in ("read_large_logs", "read_small_logs"):
    query(_name, ["log_lines"], "SELECT file_id, line_no, md5(raw) AS raw_md5 FROM log_lines")
query(
    "cited_lines",
    ["long_log_lines"],
    """
WITH f AS (SELECT file_id, max(line_no) AS n FROM long_log_lines GROUP BY file_id ORDER BY n DESC, file_id LIMIT 1)
SELECT file_id, line_no, md5(raw) AS raw_md5 FROM long_log_lines JOIN f USING (file_id) WHERE line_no BETWEEN n // 4 + 1 AND n // 4 + 40
""",
)
query("ingested_batches", ["groups"], "SELECT group_id, user_id, file_id, level, n AS count FROM groups")
query("tenant_groups", ["groups"], "SELECT group_id, file_id, level, n AS count FROM groups WHERE user_id = 3")
query("versioned_severities", ["enriched"], "SELECT group_id, severity FROM enriched")
