"""Fixed values and rule texts: everything a job treats as data rather than as logic."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from faultline.schemas import S


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    categories: list[str]
    min_severity: str
    keywords: list[str]
    base_confidence: float
    severity: str
    summary: str
    explanation: str
    remediation: str
    enabled: bool = True


# Ids, categories, minimum severities, keywords and confidences of the rule catalogue.
RULES: tuple[Rule, ...] = (
    Rule("http_500_spike", "HTTP 500 errors", ["web"], "warning",
         ["500", "internal server error"], 0.80, "warning",
         "Server errors (500) on {domain}",
         "Requests to {domain} (account {account}) end in status 500, seen in {log_file}. The site code or its configuration is failing.",
         "Look at the application log of the site, then at its latest deployment and configuration changes."),
    Rule("http_503_spike", "HTTP 503 errors", ["web"], "warning",
         ["503", "service unavailable"], 0.85, "critical",
         "Requests refused (503) on {domain}",
         "The web server turns requests for {domain} (account {account}) away with status 503. Workers or backends are exhausted.",
         "Compare load with the worker limits, find slow backends and check whether one client sends most requests."),
    Rule("suspicious_request", "Suspicious request", ["security", "web"], "warning",
         ["suspicious", "wp-login", "xmlrpc", "phpmyadmin", "eval(", "base64", "shell"], 0.70, "warning",
         "Probing request from {ip}",
         "Client {ip} asked {domain} for a path that scanners look for: {message}",
         "Check what else this client requested and block it when the requests continue."),
    Rule("brute_force_login", "Failed login", ["auth"], "warning",
         ["failed", "login", "authentication", "denied"], 0.75, "warning",
         "Login failure for {account} from {ip}",
         "A login for {account} from {ip} was refused: {message}",
         "Watch this address for more failures, lock it out, and ask for stronger credentials."),
    Rule("csf_block", "Firewall block", ["security"], "warning",
         ["blocked", "denied", "csf"], 0.80, "warning",
         "Firewall blocked {ip}",
         "The firewall acted against {ip}: {message}",
         "Confirm that the address is not one of your own, then leave the block in place."),
    Rule("malware_detection", "Malware found", ["malware", "security"], "warning",
         ["malware", "virus", "trojan", "infected", "malicious", "quarantined"], 0.90, "critical",
         "Malware reported for account {account}",
         "The scanner reported malicious content: {message}",
         "Isolate the files, rotate the credentials of the account and close the way the files came in."),
    Rule("slow_query_spike", "Slow queries", ["database"], "warning",
         ["slow query", "query_time"], 0.70, "warning",
         "Slow database queries (account {account})",
         "A query ran far longer than expected: {message}",
         "Explain the statement, add the missing index and limit what it reads."),
    Rule("mysql_connection_limit", "Database connection limit", ["database"], "critical",
         ["too many connections", "max_connections", "connection refused"], 0.90, "critical",
         "Database is out of connections",
         "The database no longer accepts clients: {message}",
         "Find the clients that hold connections, then fix their pools before raising the limit."),
    Rule("mysql_access_denied", "Database access denied", ["database"], "warning",
         ["access denied"], 0.60, "warning",
         "Database refused a user",
         "The database refused credentials: {message}",
         "Compare the stored credentials of the application with the grants."),
    Rule("high_cpu", "High CPU", ["resource"], "warning",
         ["cpu"], 0.80, "warning",
         "CPU is saturated",
         "CPU use crossed its limit: {message}",
         "List the busiest processes and their owners, then limit or move them."),
    Rule("high_memory", "High memory", ["resource"], "warning",
         ["memory", "oom", "out of memory"], 0.85, "warning",
         "Memory is nearly exhausted",
         "Memory use crossed its limit: {message}",
         "List the largest processes and lower their limits before the kernel kills one."),
    Rule("disk_space_warning", "Disk filling up", ["resource"], "warning",
         ["disk", "no space", "disk full"], 0.90, "critical",
         "Disk is nearly full",
         "Disk use crossed its limit: {message}",
         "Remove old logs and backups, then find which account grows."),
    Rule("oom_kill", "Out-of-memory kill", ["system", "resource"], "critical",
         ["oom", "out of memory", "killed process"], 0.95, "critical",
         "The kernel killed a process to free memory",
         "Memory ran out and a process was killed: {message}",
         "Find which process grew, and restart what was killed."),
    Rule("service_crash", "Service crash", ["system", "service"], "critical",
         ["segfault", "crash", "core dump", "fatal", "aborting"], 0.90, "critical",
         "Crash: {message}",
         "A process ended abnormally, seen in {log_file}: {message}",
         "Restart the service and keep its core file and log for analysis."),
    Rule("backup_failure", "Backup failure", ["backup"], "warning",
         ["failed", "error", "abort", "cannot", "permission denied"], 0.85, "critical",
         "A backup did not finish",
         "The backup job reported a problem: {message}",
         "Check free space and permissions of the target, then run the job again."),
)

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", S), T.StructField("name", S), T.StructField("categories", T.ArrayType(S)),
    T.StructField("min_severity", S), T.StructField("keywords", T.ArrayType(S)),
    T.StructField("base_confidence", T.DoubleType()), T.StructField("severity", S),
    T.StructField("summary", S), T.StructField("explanation", S), T.StructField("remediation", S),
    T.StructField("enabled", T.BooleanType()),
])


@dataclass(frozen=True)
class Pattern:
    pattern: str
    min_events: int
    window_s: int
    categories: list[str]
    severity: str
    key: str = "ip_address"


# The pattern catalogue (minimum events per window over the listed categories).
PATTERNS: tuple[Pattern, ...] = (
    Pattern("brute_force", 5, 300, ["auth"], "critical", "ip_address"),
    Pattern("connection_flood", 20, 60, ["web"], "critical", "ip_address"),
    Pattern("resource_abuse", 3, 300, ["resource"], "warning", "account"),
    Pattern("database_abuse", 5, 300, ["database"], "warning", "account"),
    Pattern("multi_source_abuse", 3, 300, ["resource", "database", "web"], "critical", "account"),
    Pattern("security_spike", 5, 300, ["security", "malware"], "critical", "ip_address"),
    Pattern("backup_failure", 2, 3600, ["backup"], "warning", "host"),
)


@dataclass(frozen=True)
class CountLimit:
    """A "so many per window" limit. ``predicate`` is a Spark SQL condition on the event table."""

    limit_id: str
    predicate: str
    window_s: int
    limit: int
    key: str = "host"


# Declared counting limits per window.
COUNT_LIMITS: tuple[CountLimit, ...] = (
    CountLimit("http_500", "category in ('web','security') and status_code = 500", 300, 50),
    CountLimit("http_503", "category in ('web','security') and status_code = 503", 300, 20),
    CountLimit("connection_flood", "category = 'web'", 300, 500, "ip_address"),
    CountLimit("request_rate", "category in ('web','security') and status_code is not null", 60, 1000, "ip_address"),
    CountLimit("failed_logins", "category = 'auth' and severity <> 'info'", 300, 10, "ip_address"),
    CountLimit("firewall_blocks", "event_type = 'csf_block'", 300, 20),
    CountLimit("malware_detections", "category = 'malware'", 300, 5),
    CountLimit("slow_queries", "event_type = 'slow_query'", 300, 20),
)


@dataclass(frozen=True)
class PatternText:
    pattern: str
    severity: str
    summary: str
    explanation: str
    remediation: str


# Texts of correlated incidents; {n}, {ip}, {account}, {pattern}, {areas} and {names} are filled per row.
PATTERN_TEXTS: tuple[PatternText, ...] = (
    PatternText("brute_force", "critical",
                "Login attack from {ip}: {n} authentication events",
                "Address {ip} produced {n} authentication events inside one window, which looks like password guessing.",
                "Block the address and look for a successful login among its attempts."),
    PatternText("connection_flood", "critical",
                "Request flood from {ip}: {n} requests",
                "Address {ip} caused {n} web events inside one window; it floods or crawls the server.",
                "Limit the request rate of the address and check which site it hits."),
    PatternText("database_abuse", "warning",
                "Account {account} overuses the database: {n} events",
                "Account {account} caused {n} events in one window, most of them from the database.",
                "Review the slow statements and connection use of the account."),
    PatternText("multi_source_abuse", "critical",
                "Account {account} causes trouble in {areas} areas",
                "Account {account} raises warnings in several areas at once: {names}. It may be attacked or compromised.",
                "Inspect the files, processes and traffic of the account, and suspend it if this goes on."),
    PatternText("security_spike", "critical",
                "Security events rise: {n} from {ip}",
                "{n} security events fell into one window, which points to scanning or an attack.",
                "Read the firewall and scanner logs for this window and scan the touched accounts."),
)

GENERIC_TEXT = PatternText("*", "warning",
                           "Correlated events: {pattern} ({n} events)",
                           "Pattern {pattern} was found over {n} related events.",
                           "Look at the related events and act on their cause.")

TEXT_SCHEMA = T.StructType([T.StructField(n, S) for n in ("pattern", "severity", "summary", "explanation", "remediation")])


@dataclass(frozen=True)
class LogSource:
    log_name: str
    source: str
    parser: str
    path: str
    plugin: str = ""
    enabled: bool = True
    priority: int = field(default=0)


# Log names, source labels, default paths, and the parser meant for each log.
CORE_SOURCES: tuple[LogSource, ...] = (
    LogSource("apache_access", "web", "web", "/var/log/apache2/access_log"),
    LogSource("apache_error", "web", "web", "/var/log/apache2/error_log"),
    LogSource("mysql_error", "database", "database", "/var/log/mysql/error.log"),
    LogSource("mysql_slow", "database", "database", "/var/log/mysql/slow.log"),
    LogSource("auth_log", "security", "auth", "/var/log/secure"),
    LogSource("syslog", "system", "system", "/var/log/messages"),
    LogSource("cpanel_access", "cpanel", "panel", "/usr/local/cpanel/logs/access_log"),
    LogSource("cpanel_error", "cpanel", "panel", "/usr/local/cpanel/logs/error_log"),
)
OPTIONAL_SOURCES: tuple[LogSource, ...] = (
    LogSource("litespeed_access", "web", "web", "/usr/local/lsws/logs/access.log", "litespeed", True, 1),
    LogSource("litespeed_error", "web", "web", "/usr/local/lsws/logs/error.log", "litespeed", True, 1),
    LogSource("imunify360", "security", "malware", "/var/log/imunify360/console.log", "imunify360", True, 1),
    LogSource("csf_log", "security", "firewall", "/var/log/lfd.log", "csf", True, 1),
    LogSource("backuply", "backup", "backup", "/var/log/backuply.log", "backuply", True, 1),
    LogSource("softaculous", "system", "system", "/var/log/softaculous.log", "softaculous", True, 1),
    LogSource("wptoolkit", "web", "toolkit", "/var/log/plesk/wt.log", "wptoolkit", True, 1),
)
SOURCE_SCHEMA = T.StructType([
    T.StructField("log_name", S), T.StructField("source", S), T.StructField("parser", S), T.StructField("path", S),
    T.StructField("plugin", S), T.StructField("enabled", T.BooleanType()), T.StructField("priority", T.IntegerType()),
])


def literal_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Rows as one literal inside the plan.

    The planner sees how small they are and broadcasts them by itself; a frame made from a Python list is an RDD of
    unknown size to it, and it would rather broadcast or shuffle the other side.
    """
    literal = F.from_json(F.lit(json.dumps(rows)), T.ArrayType(schema))
    return spark.range(1).select(F.inline(literal))


def _frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    return literal_frame(spark, [asdict(r) for r in rows], schema)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rule catalogue as a DataFrame."""
    return _frame(spark, rules, RULE_SCHEMA)


def scan_rules(spark: SparkSession, rule_id: str | None = None, enabled_only: bool = False) -> DataFrame:
    rules = rules_frame(spark)
    if rule_id is not None:
        rules = rules.filter(rules.rule_id == rule_id)
    return rules.filter("enabled") if enabled_only else rules


def pattern_texts_frame(spark: SparkSession) -> DataFrame:
    return _frame(spark, PATTERN_TEXTS, TEXT_SCHEMA)


def sources_frame(spark: SparkSession, sources=CORE_SOURCES) -> DataFrame:
    return _frame(spark, sources, SOURCE_SCHEMA)
