"""Vocabularies, patterns, limits and texts that results depend on.

Everything in this module is a constant of the data model.  Two engines only
agree on a result when they agree on these values, so they live in one place
and are stated as plain text.
"""

# --- fixed values: level and severity vocabularies ---------------------------
LEVELS = ["debug", "info", "warning", "error", "critical"]
LEVEL_ALIASES = {
    "warn": "warning",
    "err": "error",
    "fatal": "critical",
    "crit": "critical",
    "emerg": "critical",
    "panic": "critical",
    "trace": "debug",
    "notice": "info",
}
GROUPED_LEVELS = ["warning", "error", "critical"]
SEVERITY_BY_LEVEL = {"critical": "critical", "error": "high", "warning": "medium"}
SEVERITIES = ["critical", "high", "medium", "low"]  # rank 0..3
UNKNOWN_SEVERITY_RANK = 9

# --- fixed values: ASCII whitespace -------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c"

# --- fixed values: log formats, in order of preference -------------------------
FORMATS = ["json", "logfmt", "syslog", "plain"]
MIN_FORMAT_SCORE = 0.5

# --- fixed values: JSON-lines keys, first present wins --------------------------
JSON_TIME_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime"]
JSON_LEVEL_KEYS = ["level", "severity", "lvl", "loglevel", "log.level"]
JSON_MESSAGE_KEYS = ["message", "msg", "event", "log"]

# --- fixed values: logfmt ---------------------------------------------------------
LOGFMT_PAIR = r'([A-Za-z0-9_.@-]+)=("(?:[^"\\]|\\.)*"|\S+)'
LOGFMT_KNOWN_KEYS = ["level", "msg", "time", "ts"]

# --- fixed values: syslog ---------------------------------------------------------
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SYSLOG_LINE = (
    r"(?s)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+([\w./-]+)(?:\[(\d+)\])?:\s*(.*)$"
)
SYSLOG_LEVEL_WORD = r"(?i)\b(error|err|warn|warning|crit|critical|fatal|fail(?:ed|ure)?)\b"

# --- fixed values: freeform lines ---------------------------------------------------
PLAIN_LINE = (
    r"(?is)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?"
    r"\s*\[?(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|CRIT(?:ICAL)?|FATAL|TRACE)?\]?"
    r"[:\s-]*(.*)$"
)
PLAIN_ERROR_HINT = r"(?i)\b(error|exception|fail(?:ed|ure)?|timeout|refused|denied)\b"

# --- fixed values: timestamp shapes -------------------------------------------------
TIMESTAMP_SPACED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?$"
TIMESTAMP_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?$"
TIMESTAMP_ZONED = r"(?:Z|[+-]\d{2}:?\d{2})$"

# --- fixed values: template rules, applied in this order to the lower-cased text ------
TEMPLATE_RULES = [
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<ip>"),
    (r"(?i)\b[0-9a-f]{12,64}\b", "<hex>"),
    (r"'[^']*'", "<str>"),
    (r'"[^"]*"', "<str>"),
    (r"(?:/[\w.\-]+){2,}", "<path>"),
    (r"\b\d+(?:\.\d+)?\b", "<n>"),
    (r"\s+", " "),
]
ISO_FIXED_TIMESTAMP_RULE = (
    r"(?i)\b\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:z|[+-]\d{2}:?\d{2})?\b"
)

# --- fixed values: group limits -------------------------------------------------------
SAMPLES_PER_GROUP = 5

# --- fixed values: ingest limits --------------------------------------------------------
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_PASTE_BYTES = 1024 * 1024
FILENAME_CHARS = 255
SUFFIX_CHARS = 16
DEFAULT_SUFFIX = ".log"

# --- fixed values: text fence -------------------------------------------------------------
FENCE_OPEN = "<<<LOG_DATA_7f3a>>>"
FENCE_CLOSE = "<<<END_LOG_DATA_7f3a>>>"
FENCE_LOOKALIKE = r"(?i)<{2,3}/?\s*(END_)?LOG_DATA[^>]*>{2,3}"
FENCE_REPLACEMENT = "[fence-removed]"

# --- fixed values: command guard --------------------------------------------------------------
SAFE_COMMAND_PATTERNS = [
    r"^kubectl (get|describe|logs|top|explain)\b",
    r"^systemctl (status|list-units|is-active)\b",
    r"^journalctl\b",
    r"^docker (ps|logs|inspect|stats|top)\b",
    r"^(ping|traceroute|nslookup|dig)\b",
    r"^nc -z?v?\b",
    r"^curl -(s|I|sI|v)\b",
    r"^(df|free|uptime|top|ps|vmstat|iostat)\b",
    r"^(ss|netstat)\b",
    r"^pg_isready\b",
    r"^redis-cli ping\b",
    r"^aws (logs|cloudwatch|ec2 describe-|rds describe-|s3 ls)\S*",
]
SHELL_METACHARACTERS = r"[;&|`$><]"
COMMAND_CHARS = 200

# --- fixed values: classifier rules -------------------------------------------------------------
CLASSIFIER_RULES = [
    {
        "keywords": ["database", "postgres", "connection", "timeout", "refused"],
        "severity": "critical",
        "error_type": "Database Connectivity",
        "root_cause": "The application cannot establish a connection to the database.",
        "possible_reasons": [
            "Database service is down",
            "Wrong credentials or connection string",
            "Firewall or network issue",
            "Connection pool exhausted",
        ],
        "suggested_fix": "Verify database status and connectivity from the application host.",
        "recommended_commands": [
            "kubectl get pods",
            "kubectl describe pod postgres-0",
            "kubectl logs postgres-0 --tail=100",
            "systemctl status postgresql",
        ],
        "confidence": 0.94,
    },
    {
        "keywords": ["memory", "oom", "killed"],
        "severity": None,
        "error_type": "Resource Exhaustion",
        "root_cause": "A process ran out of memory and was terminated.",
        "possible_reasons": ["Memory leak", "Undersized container limits", "Traffic spike"],
        "suggested_fix": "Inspect memory usage trends and raise limits or fix the leak.",
        "recommended_commands": ["kubectl top pods", "free -m", "dmesg | tail"],
        "confidence": 0.88,
    },
    {
        "keywords": ["slow", "query", "latency"],
        "severity": None,
        "error_type": "Performance Degradation",
        "root_cause": "Operations are exceeding expected duration thresholds.",
        "possible_reasons": ["Missing index", "Lock contention", "Resource saturation"],
        "suggested_fix": "Identify the slow operation and profile it.",
        "recommended_commands": ["kubectl top pods"],
        "confidence": 0.75,
    },
]
CLASSIFIER_MIN_HITS = 2
CLASSIFIER_FALLBACK = {
    "severity": None,
    "error_type": "Application Error",
    "root_cause": "An application-level error occurred; see sample log lines.",
    "possible_reasons": ["Bug in application code", "Unexpected input", "Dependency failure"],
    "suggested_fix": "Inspect the sample lines and the surrounding log context.",
    "recommended_commands": [],
    "confidence": 0.5,
}
EXPLANATION_TAIL = (
    "In simple terms: the system tried to do something and the other side "
    "did not respond as expected."
)
RULES_MODEL = "mock"
PROMPT_VERSION = "analysis-v1"

# --- fixed values: insight limits ---------------------------------------------------------------
ERROR_TYPE_CHARS = 64
ROOT_CAUSE_CHARS = 1000
EXPLANATION_CHARS = 2000
SUGGESTED_FIX_CHARS = 1000
MAX_REASONS = 6
MAX_COMMANDS = 8

# --- fixed values: similarity and retrieval --------------------------------------------------------
VECTOR_DIM = 256
VECTOR_TOKEN = r"[a-z]{2,}"
SIMILARITY_THRESHOLD = 0.4
SIMILAR_LIMIT = 5
WINDOW_LINES = 40
OVERLAP_LINES = 10
RETRIEVAL_TOKEN = r"[a-z0-9]{2,}"
COSINE_WEIGHT = 0.5
MIN_RETRIEVAL_SCORE = 0.2
TOP_CHUNKS = 6
STOP_WORDS = [
    "the", "a", "an", "is", "was", "did", "do", "what", "why", "how",
    "when", "who", "with", "in", "on", "at", "of", "to", "and", "or",
]
REFUSAL = "I don't see anything about that in this log."
HISTORY_TURNS = 6
QUESTION_CHARS = 4000

# --- fixed values: causal check ----------------------------------------------------------------------
PLAN_SUBJECTS = 5
DOWNSTREAM_LABELS = 4
CONFIDENCE_VERIFIED = 0.85
CONFIDENCE_FIRST_FAILURE = 0.6
CONFIDENCE_NONE = 0.4
NOTE_VERIFIED = "Ordering confirms the trigger precedes the cascade."
NOTE_UNVERIFIED = "Insufficient temporal evidence to confirm causation; treat as correlation."
NO_ORDERING = "No timestamped ordering available; treating the highest-severity group as primary."

FIRST_FAILURE_FINDING = "First observed failure: %s (%d×)."
DOWNSTREAM_FINDING = "Likely downstream effects, in order: %s."
DOWNSTREAM_ARROW = " → "
TRIGGER_HYPOTHESIS = "%s was the trigger; the remaining errors are cascade effects."
ISOLATED_HYPOTHESIS = "%s is an isolated failure."

# --- fixed values: incident report texts ----------------------------------------------------------------
REPORT_TITLE = "Incident report — %s: %s"
REPORT_TITLE_CLEAN = "Incident report — %s (no errors detected)"
REPORT_GENERATED = "*Generated %s · source `%s` · %s lines, %s errors, %d distinct groups.*"
REPORT_SUMMARY_INSIGHT = "The dominant issue is **%s** (%d occurrences): %s"
REPORT_SUMMARY_TEMPLATE = "The most frequent issue occurred %d times: `%s`."
REPORT_SUMMARY_CLEAN = "No warning- or error-level entries were found in this log."
REPORT_IMPACT = "- **%s** error-level lines across **%d** distinct problems."
REPORT_SPREAD = "- Severity spread: %s."
REPORT_FINDING = "### %d. %s — %s (%d×)"
REPORT_CAUSE = "**Root cause:** %s"
REPORT_EXPLANATION = "**Explanation:** %s"
REPORT_FIX = "**Suggested fix:** %s"
REPORT_COMMANDS = "**Diagnostic commands (read-only):**"
REPORT_NO_INSIGHT = "_No AI insight available for this group._"
REPORT_SAMPLES_OPEN = "<details><summary>Sample lines</summary>"
REPORT_SAMPLES_CLOSE = "</details>"
REPORT_SAMPLE_LINES = 3
REPORT_TIP = "- Address **%s**: %s"
REPORT_TIP_GROUPS = 3
REPORT_TIP_DEFAULT = "- Review the findings above and add monitoring/alerts."

# --- fixed values: scoring request and retrieval texts ---------------------------------------------------
REQUEST_FORMAT_NOTE = " (detected format: %s)"
REQUEST_TEXT = "Error group%s\nLevel: %s\nOccurrences: %d\nNormalized template: %s\n\nSample raw lines:\n%s"
CONTEXT_TEXT = "Retrieved log excerpts:\n%s\n%s\n%s\n\nQuestion: %s"
CITATION = "[lines %d-%d]"
ANSWER_TEXT = (
    'Based on [lines %d-%d], the log shows: "%s". This is the relevant evidence for your question.'
)

# --- fixed values: command catalog: id, domain, template, description, parameters ----------------------
PARAM_PATTERNS = {
    "namespace": r"[a-z0-9][a-z0-9-]{0,62}",
    "pod": r"[a-z0-9][a-z0-9.-]{0,252}",
    "service": r"[a-zA-Z0-9@._-]{1,128}",
    "host": r"[a-zA-Z0-9.-]{1,253}",
    "port": r"[0-9]{1,5}",
    "log_group": r"[a-zA-Z0-9/_.-]{1,512}",
}
PARAM_DEFAULTS = {
    "namespace": "prod",
    "pod": "app-pod",
    "service": "postgresql",
    "host": "localhost",
    "port": "5432",
    "log_group": "/aws/app/logs",
}
COMMAND_CATALOG = [
    ("k8s_get_pods", "kubernetes", "kubectl get pods -n {namespace}",
     "List pods and their status in a namespace", ["namespace"]),
    ("k8s_describe_pod", "kubernetes", "kubectl describe pod {pod} -n {namespace}",
     "Show pod events, restarts, and scheduling issues", ["pod", "namespace"]),
    ("k8s_logs", "kubernetes", "kubectl logs {pod} -n {namespace} --tail=200",
     "Read recent logs from a pod", ["pod", "namespace"]),
    ("k8s_top_pods", "kubernetes", "kubectl top pods -n {namespace}",
     "Show CPU/memory usage per pod", ["namespace"]),
    ("linux_systemctl_status", "linux", "systemctl status {service}",
     "Check whether a service is running", ["service"]),
    ("linux_journal", "linux", "journalctl -u {service} --since '1 hour ago'",
     "Read recent service logs", ["service"]),
    ("linux_port_check", "linux", "nc -zv {host} {port}",
     "Test TCP reachability to a host:port", ["host", "port"]),
    ("linux_pg_ready", "linux", "pg_isready -h {host} -p {port}",
     "Check PostgreSQL accepts connections", ["host", "port"]),
    ("linux_disk", "linux", "df -h",
     "Show disk usage (full disks cause many failures)", []),
    ("linux_mem", "linux", "free -m",
     "Show memory usage (OOM diagnosis)", []),
    ("aws_logs_tail", "aws", "aws logs tail {log_group} --since 1h",
     "Tail a CloudWatch log group", ["log_group"]),
    ("aws_rds_describe", "aws", "aws rds describe-db-instances",
     "List RDS instances and their status", []),
]
COMMANDS_BY_ERROR_TYPE = {
    "Database Connectivity": [
        "k8s_get_pods", "k8s_logs", "linux_systemctl_status", "linux_pg_ready", "linux_port_check",
    ],
    "Resource Exhaustion": ["k8s_top_pods", "linux_mem", "linux_disk", "k8s_describe_pod"],
    "Performance Degradation": ["k8s_top_pods", "linux_mem", "k8s_logs"],
    "Application Error": ["k8s_logs", "k8s_describe_pod", "linux_journal"],
}
DEFAULT_COMMANDS = ["k8s_get_pods", "k8s_logs", "linux_disk"]

# --- fixed values: telemetry -------------------------------------------------------------------------------
SCRAPE_PATH = "/metrics"
ROUTE_ID = r"/(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]+)(/|$)"
METRIC_HELP = {
    "http_requests_total": "Total HTTP requests.",
    "http_request_duration_seconds_sum": "Sum of request durations.",
    "http_request_duration_seconds_count": "Count of measured requests.",
}
ERROR_RATIO_LIMIT = 0.05
LATENCY_LIMIT_SECONDS = 0.3
WATERMARK = "10 minutes"
