"""Explicit table schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


RAW_LINES = _struct(
    host=S, log_name=S, file_path=S, line_no=L, arrival_ts=TS, raw_line=S,
)

# What a parser may set for one line. Every parser returns this struct, or null to drop the line.
PARSED = _struct(
    ts=TS, category=S, severity=S, message=S, hostname=S, account=S, domain=S, ip_address=S,
    process=S, pid=I, metadata=S, status_code=I, method=S, path=S, size=L, user_agent=S,
    mysql_user=S, query_time=D, lock_time=D, rows_sent=L, rows_examined=L, auth_result=S, event_type=S,
)

EVENTS = _struct(
    id=S, ts=TS, host=S, source=S, category=S, severity=S, message=S, raw_line=S, hostname=S,
    account=S, domain=S, ip_address=S, process=S, pid=I, log_file=S, metadata=S, ts_parsed=B,
    status_code=I, method=S, path=S, size=L, user_agent=S, mysql_user=S, query_time=D, lock_time=D,
    rows_sent=L, rows_examined=L, auth_result=S, event_type=S,
)

SERVICES = _struct(
    host=S, name=S, display_name=S, installed=B, running=B, health=S, version=S, pid=I, uptime_seconds=L,
    last_check=TS, last_error=S, recent_events=T.ArrayType(S), config_path=S, log_path=S, metadata=S,
)

SNAPSHOTS = _struct(
    ts=TS, host=S, cpu_percent=D, cpu_count=I, memory_total_mb=D, memory_used_mb=D, memory_percent=D,
    swap_total_mb=D, swap_used_mb=D, swap_percent=D, disk_total_gb=D, disk_used_gb=D, disk_percent=D,
    disk_inodes_used_percent=D, load_1=D, load_5=D, load_15=D, network_connections=L, process_count=L,
    uptime_seconds=L, db_queries_sec=D, db_connections=L,
)

ACTIONS = _struct(
    id=S, ts=TS, user=S, action=S, target_type=S, target_id=S, details=S, ip_address=S,
)

# The closed vocabularies of the data model.
SEVERITIES = ("info", "warning", "critical")
CATEGORIES = (
    "resource", "security", "web", "database", "backup",
    "service", "system", "network", "malware", "auth",
)
INCIDENT_STATES = ("new", "acknowledged", "investigating", "resolved", "suppressed", "false_positive")
ACTIVE_STATES = ("new", "acknowledged", "investigating")
CLOSED_STATES = ("resolved", "suppressed", "false_positive")
OPERATOR_STATES = ("acknowledged", "investigating", "resolved", "suppressed", "false_positive")
