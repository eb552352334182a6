"""Input tables derived from the driver's tables by one formula in both SQL dialects.

Only inputs are derived here; what the queries compute from them is written separately for Spark and DuckDB.
Marks such as <k> or <fmt access> stand for the few spellings in which the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions.times import clock
from faultline.schemas import EVENTS

# mark: (Spark spelling, DuckDB spelling)
MARKS = {
    "<k>": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "<fmt access>": ("date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "strftime(ts, '%d/%b/%Y:%H:%M:%S')"),
    "<fmt syslog>": ("date_format(ts, 'MMM dd HH:mm:ss')", "strftime(ts, '%b %d %H:%M:%S')"),
    "<fmt plain>": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "<fmt iso>": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S')"),
    "<fmt short>": ("date_format(ts, 'yyMMdd HH:mm:ss')", "strftime(ts, '%y%m%d %H:%M:%S')"),
    "<fmt monthday>": ("date_format(ts, 'MMM dd')", "strftime(ts, '%b %d')"),
    "<fmt clock>": ("date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"),
    "<arr(": ("array(", "list_value("),
    "<newline>": ("'\\n'", "chr(10)"),
    "<idiv ": (" div ", " // "),
}


def _dialect(sql: str, which: int) -> str:
    for mark, spelling in MARKS.items():
        sql = sql.replace(mark, spelling[which])
    return sql


_LINES = """select 'host' || (user_id % 2) as host, '{log}' as log_name, '/var/log/{log}/' || (user_id % 3) as file_path,
  event_id as line_no, ts as arrival_ts, {text} as raw_line from base{where}"""


def _lines(log: str, text: str, where: str = "") -> str:
    return _LINES.format(log=log, text=text, where=f" where {where}" if where else "")


# name -> SQL over the driver's tables and earlier names
INPUTS: dict[str, str] = {
    "base": "select event_id, ts, user_id, event_type, value, <k> as k from events",
    "ev0": """select *, lpad(cast(event_id as string), 10, '0') as id, 'host' || (user_id % 2) as host,
  case when event_type = 'error' then 'web' when event_type = 'signup' then 'auth'
       when event_type = 'click' then case when k % 10 = 3 then 'malware' else 'security' end
       when event_type = 'view' then 'database'
       else case when k % 10 = 4 then 'backup' when k % 10 = 5 then 'system' else 'resource' end end as category,
  case when value >= 100 then 'critical' when value >= 30 then 'warning' else 'info' end as severity,
  case when k % 11 = 0 then '' else '10.0.0.' || (user_id % 20) end as ip_address,
  case when k % 4 = 0 then null else 'acct' || (user_id % 25) end as account,
  case when k % 5 = 1 then null else 'site' || (user_id % 40) || '.com' end as domain from base""",
    "ev": """select id, ts, host, category as source, category, severity,
  case category
    when 'web' then case k % 3 when 0 then 'HTTP 503 error: GET /p/' || k when 1 then 'HTTP 500 error: GET /p/' || k
                               else 'Suspicious request: GET /wp-login.php' end
    when 'auth' then case k % 2 when 0 then 'Failed login attempt for u' || user_id else 'Session note for u' || user_id end
    when 'security' then case k % 3 when 0 then 'CSF: IP blocked' when 1 then 'Quarantined file' else 'Port probe' end
    when 'malware' then 'Imunify360: Malware detected in /home/u' || user_id
    when 'database' then case k % 4 when 0 then 'Slow query by u' || user_id when 1 then 'Too many connections'
                                    when 2 then 'MySQL access denied for u' || user_id else 'Checkpoint note' end
    when 'backup' then case k % 2 when 0 then 'Backup failure: cannot write' else 'Backup completed' end
    when 'system' then 'kernel: segfault at ' || k
    else case k % 3 when 0 then 'CPU usage high: ' || k when 1 then 'Memory usage high: ' || k else 'Disk space low: ' || k end
  end as message,
  id || ' ' || category || ' line ' || k as raw_line, account, domain, ip_address,
  '/var/log/' || category || '.' || (k % 3) || '.log' as log_file,
  '{"k":' || k || ',"kind":"' || event_type || '"}' as metadata,
  case when category = 'web' and k % 3 = 0 then 503 when category = 'web' and k % 3 = 1 then 500 end as status_code,
  case when category = 'database' then case when k % 3 = 0 then 'acct' || (user_id % 30)
       when k % 3 = 1 then 'acct' || (user_id % 30) || '_db' || k else 'app' || k end end as mysql_user,
  case when category = 'security' and k % 3 = 0 then 'csf_block' when category = 'database' and k % 4 = 0 then 'slow_query' end as event_type,
  k, user_id, value from ev0""",
    "inc": """select 'inc' || id as id, host, ts, ts as updated_at, severity, category,
  case k % 6 when 0 then 'new' when 1 then 'acknowledged' when 2 then 'investigating' when 3 then 'resolved'
             when 4 then 'suppressed' else 'false_positive' end as state,
  'rule_' || category as rule_id, message as summary, 'About: ' || message as explanation,
  account as affected_account, source as affected_service, domain as affected_domain, ip_address as affected_ip,
  <arr(raw_line, 'second line', 'third') as source_evidence, <arr(id) as event_ids,
  0.5 + (k % 5) / 10.0 as confidence_score, 'Look' as suggested_remediation, <arr(log_file) as logs_consulted,
  md5(category || ':' || (k % 7)) as fingerprint, cast(1 + k % 3 as bigint) as occurrence_count,
  '' as resolution_notes, metadata, cast(k % 2 as bigint) as suppressed_count, k from ev where severity <> 'info'""",
    "al": """select 'al' || id as id, host, ts, id as incident_id, severity, category, summary as title, explanation as message,
  coalesce(nullif(affected_account, ''), nullif(affected_ip, ''), nullif(affected_service, ''), 'unknown') as affected_entity,
  k % 4 = 0 as acknowledged, case when k % 4 = 0 then 'op' end as acknowledged_by,
  cast(null as timestamp) as acknowledged_at, k % 9 = 0 as suppressed, k from inc""",
    "snap": """select ts, 'host' || (user_id % 2) as host, cast((event_id * 37) % 101 as double) as cpu_percent, 8 as cpu_count,
  cast((event_id * 53) % 101 as double) as memory_percent, cast((event_id * 71) % 101 as double) as disk_percent,
  cast((event_id * 29) % 101 as double) as disk_inodes_used_percent, cast((event_id % 320) / 10.0 as double) as load_1,
  k as db_connections, event_id from base""",
    "procs": """select 'host' || (l_orderkey % 2) as host, l_shipdate as ts, l_orderkey * 10 + l_linenumber as pid,
  'p' || (l_partkey % 50) as name, 'acct' || (l_suppkey % 25) as user, l_discount * 1000 as cpu_percent,
  l_tax * 100 as memory_percent, 'run --part ' || l_partkey as cmdline from lineitem""",
    "dbprocs": """select 'host' || (o_orderkey % 2) as host, o_orderdate as ts, o_orderkey as pid,
  case o_orderkey % 7 when 0 then 'root' when 1 then 'event_scheduler' else 'acct' || (o_custkey % 25) end as user,
  'db' || (o_custkey % 9) as db, case o_orderstatus when 'O' then 'Sleep' else 'Query' end as command,
  o_orderkey % 97 as time, 'executing' as state, 'select * from t' || o_orderkey || repeat(' and more', 12) as info from orders""",
    "accounts": """select 'acct' || c_custkey as username, '10.1.' || (c_custkey % 5) || '.1' as ip,
  c_mktsegment as plan  from customer""",
    "domains": """select 'site' || c_custkey || '.com' as domain, 'acct' || (c_custkey % 400) as account from customer""",
    "users": "select 'acct' || c_custkey as mysql_user, 'acct' || c_custkey as account from customer",
    "probes": """select 'host' || (s_suppkey % 2) as host, s_name as name, s_suppkey % 5 <> 0 as installed,
  s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0 as running,
  case s_suppkey % 4 when 0 then 'nginx version: ' || (s_suppkey % 9) || '.' || (s_suppkey % 7) || '.' || s_suppkey
    when 1 then 'Server v' || (s_suppkey % 9) || '.' || (s_suppkey % 13) || ' built' when 2 then 'unknown build'
    else 'Apache/2.4.' || s_suppkey || '.7' || <newline> || 'extra line 9.9.9' end as version_text, s_suppkey, s_nationkey from supplier""",
    "acts": """select 'act' || id as id, ts, 'op' || (k % 5) as user,
  case k % 7 when 0 then 'update_incident_resolved' when 1 then 'update_incident_acknowledged' when 2 then 'update_incident_deleted'
             when 3 then 'update_incident_suppressed' else 'acknowledge_alert' end as action,
  case when k % 7 < 4 then 'incident' else 'alert' end as target_type,
  case when k % 7 < 4 then 'inc' else 'alinc' end || lpad(cast(cast(id as bigint) <idiv 3 * 3 as string), 10, '0') as target_id,
  '{"notes":"n' || k || '"}' as details from ev""",
    "access_lines": _lines("apache_access", """'10.0.' || (user_id % 7) || '.' || (user_id % 20) || ' - - [' || <fmt access> || ' +0000] "'
  || case when k % 2 = 0 then 'GET' else 'POST' end || ' ' || case when k < 10 then '/WP-Login.php' when k < 15 then '/.env' else '/p/' || k end
  || ' HTTP/1.1" ' || case event_type when 'error' then case when k % 3 = 0 then '503' else '500' end when 'signup' then '401'
     when 'click' then '403' when 'view' then '200' else '404' end
  || ' ' || case when k % 7 = 0 then '-' else cast(event_id % 5000 as string) end
  || case when k % 5 = 0 then '' else ' "-" "agent ' || k || '"' end"""),
    "error_lines": _lines("apache_error", """case when k % 3 = 0 then '[Mon ' || <fmt monthday> || ' ' || <fmt clock> || '.123456 2024] [core:'
    || case k % 5 when 0 then 'error' when 1 then 'warn' when 2 then 'crit' when 3 then 'notice' else 'info' end
    || '] [pid 12:tid 7] [client 10.0.0.' || (user_id % 20) || ':4711] File missing on server: Site' || (user_id % 40) || '.COM now'
  when k % 3 = 1 then <fmt plain> || '.250 [' || case when k % 2 = 0 then 'ERROR' else 'WARN' end || '] [mod_x] request failed'
  else 'garbage ' || k end"""),
    "auth_lines": _lines("auth_log", """<fmt syslog> || ' srv' || (user_id % 3) || ' sshd[' || event_id || ']: ' || case k % 5
    when 0 then 'Failed password for invalid user u' || user_id || ' from 10.0.0.' || (user_id % 20) || ' port 22 ssh2'
    when 1 then 'Accepted password for u' || user_id || ' from 10.0.0.' || (user_id % 20) || ' port 22 ssh2'
    when 2 then 'authentication failure; logname= uid=0 user=u' || user_id || ' rhost=10.9.9.9'
    when 3 then 'pam_unix(sshd:session): session opened for user u' || user_id
    else 'Connection closed by 10.0.0.1' end"""),
    "fw_lines": _lines("csf_log", """<fmt syslog> || ' srv lfd: ' || case k % 4 when 0 then '*Blocked* 10.3.' || k || '.9 in csf'
    when 1 then 'brute-force from 10.4.' || k || '.1' when 2 then 'LOGIN  FAILURE seen; login failure 10.5.0.' || k else 'ok line' end"""),
    "mal_lines": _lines("imunify360", """<fmt plain> || case when k % 2 = 0 then ' [WARN] ' else ' ' end || case k % 3
    when 0 then 'Trojan found in /home/u' || user_id || ' from 10.6.0.' || k when 1 then 'file quarantined 10.7.0.' || k else 'scan step ' || k end"""),
    "db_lines": _lines("mysql_error", """case k % 4
    when 0 then <fmt iso> || '.123456Z ' || k || ' [ERROR] [MY-0' || k || '] Access denied for user ''acct' || (user_id % 30) || '_w''@''localhost'' (using password)'
    when 1 then <fmt plain> || ' ' || k || ' [Warning] Aborting connection ' || k
    when 2 then <fmt short> || ' [ERROR] mysqld: Too many connections'
    else <fmt iso> || 'Z 0 [Note] ready ' || k end"""),
    "slow_lines": _lines("mysql_slow", """case when k % 4 = 0 then '# User@Host: u' || user_id || '[u] @ web' || (k % 3) || ' [10.0.0.' || (user_id % 20) || ']'
    when k % 4 = 1 then 'select ' || k else '# Query_time: ' || (k % 60) || '.25  Lock_time: 0.5 Rows_sent: ' || k || '  Rows_examined: ' || event_id end"""),
    "panel_lines": _lines("cpanel_access", """case k % 5
    when 0 then <fmt plain> || ' ' || case when k % 2 = 0 then 'FAILED' else 'SUCCESS' end || ' user=acct' || user_id || ' ip=10.0.0.' || (user_id % 20)
    when 1 then '10.0.0.' || (user_id % 20) || ' - u [' || <fmt access> || '] "GET /login/' || k || ' HTTP/1.1" ' || (200 + (k % 4) * 100) || ' ' || k
    when 2 then '[' || <fmt plain> || '] ' || case k % 4 when 0 then 'error' when 1 then 'CRIT' when 2 then 'warn' else 'debug' end || ' text ' || k
    when 3 then <fmt plain> || ' OK' || ' ip=10.0.0.7'
    else 'free text ' || k end"""),
    "backup_lines": _lines("backuply", """case k % 5 when 0 then <fmt plain> || ' Backup of u' || user_id || ' FAILED' when 1 then <fmt plain> || ' finished'
    when 2 then 'partial copy ' || k when 3 then 'completed with 0 errors' else 'heartbeat ' || k end"""),
    "sys_lines": _lines("syslog", """case k % 7 when 0 then <fmt syslog> || ' srv kernel: Out of memory: Killed process ' || event_id
    when 1 then <fmt syslog> || ' srv app[' || event_id || ']: segfault at ' || k when 2 then '[ 12.5] EXT4-fs error on sda' || k
    when 3 then <fmt syslog> || ' srv systemd[1]: Started unit ' || k when 4 then <fmt syslog> || ' srv app: warning: low on ' || k
    when 5 then <fmt syslog> || ' srv cron: tick ' || k else 'free text' end"""),
    "kit_lines": _lines("wptoolkit", """case k % 5 when 0 then 'Exploit attempt on site' || user_id when 1 then 'Fatal: plugin ' || k
    when 2 then 'deprecated call ' || k when 3 then 'theme upgraded ' || k else 'tick' end"""),
}
INPUTS["all_lines"] = " union all ".join(
    f"select * from {n}" for n in ("access_lines", "error_lines", "auth_lines", "fw_lines", "mal_lines", "db_lines", "slow_lines",
                                   "panel_lines", "backup_lines", "sys_lines", "kit_lines"))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


#: Shares of a table for each core, where its file is cut into fewer parts than that.
SHARES = 3


def _needs(sql: str, found: dict[str, None] | None = None) -> dict[str, None]:
    """Names of the inputs a text uses, dependencies first."""
    found = {} if found is None else found
    for name, body in INPUTS.items():
        if name not in found and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
            _needs(body, found)
            found[name] = None
    return found


def with_inputs(sql: str) -> str:
    """DuckDB text of a query: the inputs it uses as CTEs, then the query (which may start with its own WITH)."""
    ctes = [f"{n} as ({_dialect(INPUTS[n], 1)})" for n in _needs(sql)]
    sql = sql.strip()
    recursive = ""
    if sql[:15].lower() == "with recursive ":
        recursive, sql = "recursive ", "with " + sql[15:]
    if not ctes:
        return sql if not recursive else f"with {recursive}{sql[5:]}"
    head = f"with {recursive}" + ",\n".join(ctes)
    return f"{head},\n{sql[5:]}" if sql[:5].lower() == "with " else f"{head}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, dealt evenly over the cores.

    Only whole row groups are read by a task, and a file may have fewer of them than it has splits: then a few tasks would have all
    the rows. A small table is dealt once over the cores, a larger one in smaller shares.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, parts = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts < min(cores, 8):
        return df.repartition(cores)
    return df.repartition(SHARES * cores) if parts < SHARES * cores else df


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame; Spark sees the same formula as one query with CTEs over the Parquet files."""
    needs = _needs(f"from {name}")
    used = sorted({t for n in needs for t in TABLES if re.search(rf"\bfrom\s+{t}\b", INPUTS[n])})
    ctes = [f"{n} as ({_dialect(INPUTS[n], 0)})" for n in needs]
    for t in used:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql("with " + ",\n".join(ctes) + f"\nselect * from {name}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input ``ev`` as an event table."""
    ev = derived(spark, sf_dir, "ev")
    return ev.selectExpr(*[f"cast({f.name if f.name in ev.columns else 'null'} as {f.dataType.simpleString()}) as {f.name}"
                           for f in EVENTS.fields], "k", "user_id", "value")


def as_of(df: DataFrame) -> object:
    """Newest event time, the stand-in for "now" (one small aggregate)."""
    return clock(df.agg(F.max("ts")).first()[0])
