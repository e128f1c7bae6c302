"""SQL oracles over the request log."""

from __future__ import annotations

from logspark import fixed
from logspark.plans.oracle import QUERIES, part, q, query
from logspark.plans.telemetry_queries import DAY, HOUR, LATENCY_LIMIT, RATE_SECONDS, RATE_TIMES


def route(path: str) -> str:
    for _ in range(2):
        path = f"regexp_replace({path}, {q(fixed.ROUTE_ID)}, '/{{id}}\\1', 'g')"
    return path


part(
    "measured",
    ["request_log"],
    f"""
SELECT *, {route('path')} AS route, cast(duration_s AS decimal(18,6)) AS seconds, epoch_us(ts) AS us
FROM request_log WHERE path <> {q(fixed.SCRAPE_PATH)}
""",
)

query(
    "red_metrics",
    ["measured"],
    """
SELECT method, route, count(*) AS requests, count(CASE WHEN status >= 500 THEN 1 END) AS errors,
  cast(cast(sum(seconds) AS decimal(24,6)) AS varchar) AS duration_sum, cast(max(seconds) AS varchar) AS duration_max
FROM measured GROUP BY method, route
""",
)

_HELP = " UNION ALL ".join(
    f"SELECT {i} AS section, {q(f'# HELP {name} {text}')} AS line UNION ALL SELECT {i}, {q(f'# TYPE {name} counter')}"
    for i, (name, text) in enumerate(fixed.METRIC_HELP.items())
)
def _without_section(name: str) -> tuple[list[str], str]:
    needs, sql = QUERIES[name]
    return needs, f"SELECT line FROM ({sql})"


_LABELS = "'{method=\"' || method || '\",path=\"' || route || '\"'"
query(
    "metrics_text",
    ["measured"],
    f"""
{_HELP} UNION ALL
SELECT 0, 'http_requests_total' || {_LABELS} || ',status="' || status || '"}} ' || count(*) FROM measured GROUP BY method, route, status
UNION ALL SELECT 1, 'http_request_duration_seconds_sum' || {_LABELS} || '}} ' || cast(cast(sum(seconds) AS decimal(24,6)) AS varchar) FROM measured GROUP BY method, route
UNION ALL SELECT 2, 'http_request_duration_seconds_count' || {_LABELS} || '}} ' || count(*) FROM measured GROUP BY method, route
""",
)
query("metrics_file", *_without_section("metrics_text"))
query("total_requests", ["measured"], "SELECT count(*) AS requests FROM measured")


def windows(keys: str, hours: int) -> str:
    """Sums over the ``hours`` that end with each hour, straight from the requests."""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}(us // {HOUR * 1_000_000} + 1 + o.i) * {HOUR} AS end_s, count(*) AS requests,
  count(CASE WHEN status >= 500 THEN 1 END) AS errors, sum(seconds) AS seconds
FROM measured, range({hours}) AS o(i) GROUP BY ALL
"""


query(
    "request_rate",
    ["measured"],
    f"SELECT route, end_s, requests, round(requests / {6 * HOUR}, 6) AS rate FROM ({windows('route', 6)})",
)


def islands(keys: str, value: str, limit: float) -> str:
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    return f"""
WITH w AS ({windows(keys, 6)}),
h AS (SELECT {lead}end_s, {value} AS value FROM w WHERE {value} > {limit}),
i AS (SELECT *, end_s - {HOUR} * row_number() OVER ({over}ORDER BY end_s) AS island FROM h)"""


def alerts(keys: str, value: str, limit: float, hold_s: int) -> str:
    lead = f"{keys}, " if keys else ""
    return f"""{islands(keys, value, limit)}
SELECT {lead}min(end_s) AS pending_s, min(end_s) + {hold_s} AS firing_s, max(end_s) AS until_s, round(max(value), 6) AS peak
FROM i GROUP BY {lead}island HAVING max(end_s) - min(end_s) >= {hold_s}
"""


_RATIO = "cast(errors AS double) / requests"
query("error_ratio_alerts", ["measured"], alerts("route", _RATIO, 0.25, 3 * HOUR))
query("latency_alerts", ["measured"], alerts("route", "cast(seconds AS double) / requests", LATENCY_LIMIT, 4 * HOUR))
query("service_alerts", ["measured"], alerts("", _RATIO, 0.2, 6 * HOUR))

query(
    "down_gaps",
    ["request_log"],
    f"""
WITH l AS (SELECT client_ip, epoch_us(ts) AS back_us,
             lag(epoch_us(ts)) OVER (PARTITION BY client_ip ORDER BY ts) AS last_seen_us FROM request_log)
SELECT client_ip, last_seen_us, back_us, round((back_us - last_seen_us) / 1000000, 3) AS gap_s
FROM l WHERE back_us - last_seen_us > {2 * DAY * 1_000_000}
UNION ALL
SELECT client_ip, max(epoch_us(ts)), NULL, round(((SELECT max(epoch_us(ts)) FROM request_log) - max(epoch_us(ts))) / 1000000, 3)
FROM request_log GROUP BY client_ip
HAVING (SELECT max(epoch_us(ts)) FROM request_log) - max(epoch_us(ts)) > {2 * DAY * 1_000_000}
""",
)

part(
    "admission",
    ["request_log"],
    f"""
WITH RECURSIVE h AS (SELECT path, client_ip, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY path, client_ip ORDER BY ts, event_id) AS i FROM request_log),
walk AS (
  SELECT path, client_ip, us, i, true AS admitted, [us] AS recent FROM h WHERE i = 1
  UNION ALL
  SELECT h.path, h.client_ip, h.us, h.i,
    len(list_filter(w.recent, lambda t: h.us - t <= {RATE_SECONDS * 1_000_000})) < {RATE_TIMES},
    CASE WHEN len(list_filter(w.recent, lambda t: h.us - t <= {RATE_SECONDS * 1_000_000})) < {RATE_TIMES}
      THEN list_append(list_filter(w.recent, lambda t: h.us - t <= {RATE_SECONDS * 1_000_000}), h.us)
      ELSE list_filter(w.recent, lambda t: h.us - t <= {RATE_SECONDS * 1_000_000}) END
  FROM walk w JOIN h ON h.path = w.path AND h.client_ip = w.client_ip AND h.i = w.i + 1)
SELECT path, client_ip, us, admitted FROM walk
""",
)
query(
    "rate_limited_hits",
    ["admission"],
    """
SELECT path, client_ip, us, count(*) AS hits, count(CASE WHEN admitted THEN 1 END) AS admitted,
  count(CASE WHEN NOT admitted THEN 1 END) AS rejected FROM admission GROUP BY ALL
""",
)

query(
    "page_routes",
    [],
    f"""
SELECT {route("regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)")} AS route, count(*) AS pages
FROM pages GROUP BY ALL
""",
)

# --- final states of the streams ---------------------------------------------------------

query(
    "stream_error_groups",
    ["groups"],
    """
SELECT file_id, fingerprint, level, template, severity, n AS "count",
  strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen
FROM groups
""",
)
query(
    "stream_red",
    ["measured"],
    f"""
SELECT end_s, method, route, requests, errors, cast(cast(seconds AS decimal(18,6)) AS varchar) AS seconds
FROM ({windows('method, route', 6)})
""",
)
query("stream_alerts", ["measured"], alerts("route", _RATIO, 0.25, 3 * HOUR))
query(
    "stream_rate_limit",
    ["admission"],
    """
SELECT path, client_ip, us, count(*) AS hits, count(CASE WHEN admitted THEN 1 END) AS admitted,
  count(CASE WHEN NOT admitted THEN 1 END) AS rejected FROM admission GROUP BY ALL
""",
)
query(
    "stream_dedup",
    ["measured"],
    "SELECT method, route, status, count(*) AS requests FROM measured GROUP BY ALL",
)
QUERIES["stream_live_red"] = QUERIES["stream_red"]
query(
    "stream_alert_transitions",
    ["measured"],
    f"""{islands("route", _RATIO, 0.25)},
s AS (SELECT route, min(end_s) AS pending_s, max(end_s) AS until_s, round(max(value), 6) AS peak FROM i GROUP BY route, island)
SELECT route, 'pending' AS transition, pending_s AS at_s, pending_s, cast(NULL AS double) AS peak FROM s
UNION ALL SELECT route, 'firing', pending_s + {3 * HOUR}, pending_s, NULL FROM s WHERE until_s - pending_s >= {3 * HOUR}
UNION ALL SELECT route, CASE WHEN until_s - pending_s >= {3 * HOUR} THEN 'resolved' ELSE 'cancelled' END,
  until_s + {HOUR}, pending_s, peak FROM s
""",
)
query(
    "stream_silences",
    ["request_log"],
    f"""
WITH l AS (SELECT client_ip, epoch_us(ts) AS last_seen_us,
             lead(epoch_us(ts)) OVER (PARTITION BY client_ip ORDER BY ts) AS back_us FROM request_log),
g AS (SELECT * FROM l WHERE back_us - last_seen_us > {2 * DAY * 1_000_000})
SELECT client_ip, 'down' AS transition, last_seen_us, cast(NULL AS bigint) AS back_us, cast({2 * DAY} AS double) AS silent_s
FROM (SELECT * FROM g UNION ALL SELECT * FROM l WHERE back_us IS NULL)
UNION ALL SELECT client_ip, 'back', last_seen_us, back_us, round((back_us - last_seen_us) / 1000000, 3) FROM g
""",
)
QUERIES["stream_group_samples"] = QUERIES["stream_log_files"] = QUERIES["error_groups"]
