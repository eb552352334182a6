"""Scans and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived
from checks.registry import query
from faultline.config import ScanConfig
from faultline.catalog import CORE_SOURCES, sources_frame
from faultline.functions.text import version_number
from faultline.lineage import scratch_dir
from faultline.operators.parsers import database, panel, router, web
from faultline.operators.parsers.base import parse
from faultline.sources import lines as log_lines

ID = "sha256(host || '|' || file_path || '|' || line_no)"
TRY = "try_strptime"


def cols(*names: str):
    return [F.col(n) for n in names]


# -- scans ------------------------------------------------------------------------------------------------------

@query("scan_log_lines", """
with texts as (select 'd' || (doc_id % 4) as host, '/docs/' || source as file_path, doc_id as line_no,
    replace(replace(text, chr(10), ' '), chr(13), ' ') as t from documents),
  seen as (select * from texts where rtrim(t, chr(10) || chr(13)) <> '')
select host, file_path, line_no, cast(length(case when length(t) > 4096 then substr(t, 1, 4096) || '...[truncated]' else t end) as integer) as chars,
  md5(case when length(t) > 4096 then substr(t, 1, 4096) || '...[truncated]' else t end) as line_hash from seen""")
def _(spark, d):
    """Whole documents as over-long lines: cleaned, cut with a mark, blank ones dropped."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat(F.lit("d"), F.col("doc_id") % 4).alias("host"), F.concat(F.lit("/docs/"), "source").alias("file_path"),
        F.col("doc_id").alias("line_no"), F.translate("text", "\n\r", "  ").alias("raw_line"))
    return log_lines.scan_lines(docs, ScanConfig(max_line_length=4096)).select(
        "host", "file_path", "line_no", F.length("raw_line").alias("chars"), F.md5("raw_line").alias("line_hash"))


@query("scan_long_lines", """select sha256('h' || doc_id % 4 || '|/docs|' || doc_id) as id, 500 as status_code, length(source || replace(text, ' ', '+')) + 1 as path_chars
  from (select doc_id, source, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') as text from documents)""")
def _(spark, d):
    """Whole documents as request paths: a line of any length is parsed whole."""
    path = F.concat(F.lit("/"), F.col("source"), F.replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.lit(" "), F.lit("+")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat(F.lit("h"), F.col("doc_id") % 4).alias("host"), F.lit("/docs").alias("file_path"), F.col("doc_id").alias("line_no"),
        F.lit("apache_access").alias("log_name"), F.lit("2024-01-01").cast("timestamp_ntz").alias("arrival_ts"),
        F.concat(F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET '), path, F.lit(' HTTP/1.1" 500 1')).alias("raw_line"))
    return parse(log_lines.scan_lines(docs), web.ACCESS_LOG).select("id", "status_code", F.length("path").cast("long").alias("path_chars"))


@query("scan_multi_source", "select host, log_name, count(*) as lines, max(line_no) as last_line from all_lines group by all")
def _(spark, d):
    parts = [derived(spark, d, n) for n in (
        "access_lines", "error_lines", "auth_lines", "fw_lines", "mal_lines", "db_lines", "slow_lines", "panel_lines",
        "backup_lines", "sys_lines", "kit_lines")]
    return (log_lines.scan_lines(log_lines.union_sources(*parts)).groupBy("host", "log_name")
            .agg(F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line")))


@query("scan_failed_files", """with l as (select user_id % 3 as k from access_lines join (select event_id as line_no, user_id from base) using (line_no))
select 'source' || k as source, cast(case when k = 2 then 0 else n end as bigint) as lines, k = 2 as failed from (select k, count(*) as n from l group by k) union all select 'source9', 0, true""")
def _(spark, d):
    """Three sources and one that is not there. One archive is none: the source is left out whole and reported, the others are read."""
    root = scratch_dir(spark, "sources")
    lines = derived(spark, d, "access_lines").join(derived(spark, d, "base").select(F.col("event_id").alias("line_no"), "user_id"), "line_no")
    for k in range(3):
        lines.filter(F.col("user_id") % 3 == k).select("raw_line").repartition(3).write.text(f"{root}/source{k}/host=h{k}/log=apache_access")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/source2/host=h2/log=apache_access")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    first = next(s.getPath() for s in files.listStatus(folder) if s.getPath().getName().endswith(".txt"))
    files.rename(first, hadoop.Path(folder, "part.txt.gz"))
    read, failed = log_lines.read_sources(spark, [f"{root}/source{k}" for k in (0, 1, 2, 9)])
    name = r"(source\d)(?:/|$)"
    whole = read.groupBy(F.regexp_extract("file_path", name, 1).alias("source")).agg(F.count(F.lit(1)).alias("lines")).withColumn("failed", F.lit(False))
    return whole.unionByName(failed.select(F.regexp_extract("path", name, 1).alias("source"), F.lit(0).cast("long").alias("lines"), F.lit(True).alias("failed")))


_CORE_SQL = """(values ('apache_access', 'web', 'web'), ('apache_error', 'web', 'web'), ('mysql_error', 'database', 'database'),
  ('mysql_slow', 'database', 'database'), ('auth_log', 'security', 'auth'), ('syslog', 'system', 'system'),
  ('cpanel_access', 'cpanel', 'panel'), ('cpanel_error', 'cpanel', 'panel')) as r(log_name, source, parser)"""
_OPTIONAL_SQL = """(values ('litespeed_access', 'web', 'web'), ('litespeed_error', 'web', 'web'), ('imunify360', 'security', 'malware'),
  ('csf_log', 'security', 'firewall'), ('backuply', 'backup', 'backup'), ('softaculous', 'system', 'system'),
  ('wptoolkit', 'web', 'toolkit')) as r(log_name, source, parser)"""


@query("source_registry", f"""select r.log_name, r.source, r.parser, count(*) as lines
from all_lines l join {_CORE_SQL} on l.log_name = r.log_name group by all""")
def _(spark, d):
    core = sources_frame(spark, CORE_SOURCES).select("log_name", "source", "parser")
    return (derived(spark, d, "all_lines").join(core, "log_name").groupBy("log_name", "source", "parser")
            .agg(F.count(F.lit(1)).alias("lines")))


@query("source_registry_optional", f"""with regs as (select * from {_CORE_SQL} union all
  select * from {_OPTIONAL_SQL} where log_name in ('csf_log', 'backuply', 'imunify360'))
select l.log_name, coalesce(r.source, 'system') as source, coalesce(r.parser, 'system') as parser, count(*) as lines
from all_lines l left join regs r on l.log_name = r.log_name group by all""")
def _(spark, d):
    registry = log_lines.source_registry(spark, ("csf", "backuply", "imunify360")).select("log_name", "source", "parser")
    return (derived(spark, d, "all_lines").join(registry, "log_name", "left")
            .groupBy("log_name", F.coalesce("source", F.lit("system")).alias("source"),
                     F.coalesce("parser", F.lit("system")).alias("parser")).agg(F.count(F.lit(1)).alias("lines")))


# -- web --------------------------------------------------------------------------------------------------------

_TLDS = "('com','net','org','io','co','info','biz','us','uk','ca','au','de','fr','in','ru','jp','br','mx','za','xyz','dev','app','site','online','store','tech')"


def _domain_sql(text: str) -> str:
    names = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}.-]+'), lambda w: trim(w, '.-'))"
    return f"list_filter({names}, lambda w: contains(w, '.') and split_part(w, '.', -1) in {_TLDS})[1]"


_ACCESS_RE = ("'^([\\d.:a-fA-F]+)\\s+(\\S+)\\s+(\\S+)\\s+\\[([^\\]]+)\\]\\s+\"(\\S+)\\s+(\\S+)\\s+([^\"]+)\"\\s+(\\d{3})\\s+(\\d+|-)"
              "(?:\\s+\"([^\"]*)\"\\s+\"([^\"]*)\")?', ['ip','ident','usr','tm','method','path','proto','status','size','ref','agent']")
_MARKERS = ("['wp-login.php','xmlrpc.php','wp-admin','/admin','/phpmyadmin','/.env','/config','/backup','shell','/cgi-bin',"
            "'eval(','base64']")
_ACCESS_SQL = f"""with p as (select *, regexp_extract(raw_line, {_ACCESS_RE}) as g from access_lines),
  s as (select *, try_cast(g.status as int) as st, len(list_filter({_MARKERS}, lambda m: contains(lower(g.path), m))) > 0 as bad
        from p where g.status <> ''),
  kept as (select * from s where st >= 500 or st in (401, 403)),
  a as (select {ID} as id, try_strptime(split_part(g.tm, ' ', 1), '%d/%b/%Y:%H:%M:%S') as ts,
    case when bad then 'security' else 'web' end as category,
    case when bad then 'warning' when st = 503 then 'critical' when st >= 500 then 'warning' else 'info' end as severity,
    case when bad then 'Suspicious path asked by ' || g.ip || ': ' else 'Status ' || st || ' for ' end || g.method || ' ' || g.path as message,
    g.ip as ip_address, st as status_code, g.method as method, g.path as path,
    coalesce(try_cast(g.size as bigint), 0) as size, g.agent as user_agent, log_file_name as log_file
    from (select *, file_path as log_file_name from kept))
"""


@query("parse_web_access", _ACCESS_SQL + "select * from a")
def _(spark, d):
    return parse(derived(spark, d, "access_lines"), web.ACCESS_LOG).select(
        "id", "ts", "category", "severity", "message", "ip_address", "status_code", "method", "path", "size", "user_agent", "log_file")


@query("classify_suspicious_path", f"""select severity, category, lower(path) as path, count(*) as n
from ({_ACCESS_SQL} select * from a) where category = 'security' group by all""".replace("from ((with", "from (with"))
def _(spark, d):
    events = parse(derived(spark, d, "access_lines"), web.ACCESS_LOG)
    return (events.filter(web.suspicious_path(F.col("path"))).groupBy("severity", "category", F.lower("path").alias("path"))
            .agg(F.count(F.lit(1)).alias("n")))


_ERROR_SQL = f"""with p as (select *, regexp_extract(raw_line,
    '^\\[([^\\]]+)\\]\\s+\\[(?:(\\S+):)?(\\S+)\\]\\s+(?:\\[pid\\s+[^\\]]+\\]\\s+)?(?:\\[client\\s+([^\\]]+)\\]\\s+)?(.*)', ['tm','module','level','client','msg']) as b,
    regexp_extract(raw_line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d+)\\s+\\[(\\w+)\\]\\s+(?:\\[([^\\]]*)\\]\\s+)?(.*)', ['tm','level','module','msg']) as d
    from error_lines),
  e as (select *, lower(case when b.level <> '' then b.level else d.level end) as level,
    case when b.level <> '' then b.msg else d.msg end as msg from p where b.level <> '' or d.level <> '')
select {ID} as id, coalesce(try_strptime(regexp_replace(b.tm, '^\\w+ ', ''), '%b %d %H:%M:%S.%f %Y'), try_strptime(d.tm, '%Y-%m-%d %H:%M:%S.%g')) as ts,
  case when level in ('emerg','alert','crit') then 'critical' when level in ('error','warn') then 'warning' else 'info' end as severity,
  substr(msg, 1, 500) as message, regexp_extract(b.client, '([\\d.]+)', 1) as ip_address,
  {_domain_sql('msg')} as domain,
  case when b.level <> '' then b.module else d.module end as module from e"""


@query("parse_web_error", _ERROR_SQL)
def _(spark, d):
    return parse(derived(spark, d, "error_lines"), web.ERROR_LOG).select(
        "id", "ts", "severity", "message", "ip_address", "domain", F.get_json_object("metadata", "$.module").alias("module"))


@query("extract_client_ip", """select regexp_extract(raw_line, '\\[client ([\\d.]+)', 1) as ip, count(*) as n
from error_lines where raw_line like '[%' group by all""")
def _(spark, d):
    lines = parse(derived(spark, d, "error_lines"), web.ERROR_LOG).filter(F.col("raw_line").startswith("["))
    return lines.groupBy(F.col("ip_address").alias("ip")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_domain", f"""select coalesce({_domain_sql('html')}, '') as domain, count(*) as n from pages group by all""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.groupBy(F.coalesce(web.first_domain(F.col("html")), F.lit("")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


# -- security ---------------------------------------------------------------------------------------------------

_SYSLOG_RE = "'^(\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2})\\s+(\\S+)\\s+(\\S+?)(?:\\[(\\d+)\\])?\\s*:\\s+(.*)', ['tm','hostname','service','pid','msg']"
_SYSLOG_TS = "try_strptime(year(arrival_ts) || ' ' || g.tm, '%Y %b %d %H:%M:%S')"


@query("parse_auth", f"""with p as (select *, regexp_extract(raw_line, {_SYSLOG_RE}) as g from auth_lines),
  c as (select *, regexp_matches(g.msg, '(?i)Failed password|authentication failure|FAILED LOGIN|invalid user') as failed,
    regexp_matches(g.msg, '(?i)Accepted password|session opened|Successful login') as accepted,
    regexp_extract(g.msg, 'from\\s+(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) as ip,
    regexp_extract(g.msg, '(?:for|user[= ])\\s?(\\S+)', 1) as usr from p where g.service <> '')
select {ID} as id, {_SYSLOG_TS} as ts, case when failed then 'warning' else 'info' end as severity,
  'Login of ''' || usr || ''' through ' || g.service || case when failed then ' failed' else ' accepted' end || ', address ' || ip as message,
  ip as ip_address, g.hostname as hostname, nullif(usr, '') as account, try_cast(g.pid as int) as pid,
  case when failed then 'failed' else 'success' end as auth_result from c where failed or accepted""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "auth_lines"), "auth").select(
        "id", "ts", "severity", "message", "ip_address", "hostname", "account", "pid", "auth_result")


@query("parse_firewall", f"""with c as (select *, regexp_matches(raw_line, '(?i)brute.?force|login.?failure|authentication.?fail') as brute,
    regexp_matches(raw_line, '(?i)Blocked|Denied|dropped|rejected') as blocked,
    regexp_extract(raw_line, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) as ip from fw_lines)
select {ID} as id, arrival_ts as ts, case when brute then 'critical' else 'warning' end as severity, ip as ip_address,
  case when brute then 'csf saw a brute-force attack by ' else 'csf blocked ' end || ip as message from c where brute or blocked""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "fw_lines"), "firewall").select("id", "ts", "severity", "ip_address", "message")


@query("parse_malware_scan", f"""with p as (select *, regexp_extract(raw_line,
    '^(\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})\\s+(?:\\[(\\w+)\\]\\s+)?(.*)', ['tm','level','msg']) as g from mal_lines),
  c as (select *, regexp_matches(g.msg, '(?i)malware|virus|trojan|infected|malicious') as found,
    regexp_matches(g.msg, '(?i)blocked|denied|quarantined|cleaned') as cleaned from p where g.tm <> '')
select {ID} as id, cast(g.tm as timestamp) as ts, case when found then 'critical' else 'warning' end as severity,
  case when found then 'malware' else 'security' end as category, 'Scanner says: ' || substr(g.msg, 1, 300) as message,
  regexp_extract(g.msg, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) as ip_address, g.level as level from c where found or cleaned""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "mal_lines"), "malware").select(
        "id", "ts", "severity", "category", "message", "ip_address", F.get_json_object("metadata", "$.level").alias("level"))


# -- database ---------------------------------------------------------------------------------------------------

_DB_SQL = f"""with p as (select *, regexp_extract(raw_line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?Z?)\\s+(\\d+)\\s+\\[(\\w+)\\]\\s+(?:\\[([^\\]]*)\\]\\s+)?(.*)', ['tm','thread','level','code','msg']) as l,
    regexp_extract(raw_line, '^(\\d{{6}}\\s+\\d{{1,2}}:\\d{{2}}:\\d{{2}})\\s+\\[(\\w+)\\]\\s+(.*)', ['tm','level','msg']) as s from db_lines),
  c as (select *, lower(case when l.level <> '' then l.level else s.level end) as level, case when l.level <> '' then l.msg else s.msg end as msg
        from p where l.level <> '' or s.level <> ''),
  u as (select *, nullif(regexp_extract(msg, '(?i)Access denied for user ''([^'']+)''@''([^'']+)''', 1), '') as usr,
     regexp_extract(msg, '(?i)Access denied for user ''([^'']+)''@''([^'']+)''', 2) as client from c),
  a as (select {ID} as id, case when s.tm <> '' then try_strptime(s.tm, '%y%m%d %H:%M:%S')
      else cast(replace(replace(l.tm, 'T', ' '), 'Z', '') as timestamp) end as ts,
    case when usr is not null then 'warning'
         when regexp_matches(msg, '(?i)crash|segfault|assertion|fatal|aborting|shutting down|Too many connections|max_connections|Connection refused|Can''t connect') then 'critical'
         when level = 'error' then 'warning' else 'info' end as severity,
    case when usr is not null then 'Access denied to database user ''' || usr || ''' at ''' || client || '''' else substr(msg, 1, 500) end as message,
    usr as mysql_user, level, l.code as code from u)
"""


@query("parse_db_error", _DB_SQL + "select * from a")
def _(spark, d):
    return parse(derived(spark, d, "db_lines"), database.ERROR_LOG).select(
        "id", "ts", "severity", "message", "mysql_user", F.get_json_object("metadata", "$.level").alias("level"),
        F.get_json_object("metadata", "$.code").alias("code"))


@query("parse_access_denied", _DB_SQL + "select mysql_user, severity, message, count(*) as n from a where mysql_user is not null group by all")
def _(spark, d):
    denied = parse(derived(spark, d, "db_lines"), database.ERROR_LOG).filter("mysql_user is not null")
    return denied.groupBy("mysql_user", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


_SLOW_RE = "'^# Query_time:\\s+([\\d.]+)\\s+Lock_time:\\s+([\\d.]+)\\s+Rows_sent:\\s+(\\d+)\\s+Rows_examined:\\s+(\\d+)', ['q','l','s','e']"


@query("parse_slow_query", f"""with p as (select *, regexp_extract(raw_line, {_SLOW_RE}) as g from slow_lines)
select {ID} as id, cast(g.q as double) as query_time, cast(g.l as double) as lock_time, cast(g.s as bigint) as rows_sent,
  cast(g.e as bigint) as rows_examined, case when cast(g.q as double) > 30 then 'critical' when cast(g.q as double) > 10 then 'warning' else 'info' end as severity
from p where g.q <> ''""")
def _(spark, d):
    return router.slow_queries(derived(spark, d, "slow_lines")).select(
        "id", "query_time", "lock_time", "rows_sent", "rows_examined", "severity")


@query("slow_query_user_ffill", f"""with p as (select *, regexp_extract(raw_line, '^# User@Host:\\s+(\\S+?)(?:\\[\\S*\\])?\\s+@\\s+(\\S*)\\s+\\[([^\\]]*)\\]', ['u','c','i']) as g from slow_lines),
  h as (select *, nullif(g.u, '') as u, case when g.u <> '' then g.i end as i from p),
  f as (select *, last_value(u ignore nulls) over w as usr, last_value(i ignore nulls) over w as addr from h
        window w as (partition by host, file_path order by line_no rows between unbounded preceding and current row))
select {ID} as id, coalesce(usr, 'unknown') as mysql_user, coalesce(addr, '') as ip_address from f where raw_line like '# Query_time:%'""")
def _(spark, d):
    return router.slow_queries(derived(spark, d, "slow_lines"), block_lines=500).select("id", "mysql_user", "ip_address")


_CHUNKED = """with h as (select *, case when starts_with(raw_line, '# User@Host: ') then split_part(split_part(raw_line, ' ', 3), '[', 1) end as u from slow_lines)
select host, line_no, coalesce(last_value(u ignore nulls) over (partition by host, file_path order by line_no rows between unbounded preceding and current row), 'unknown') as mysql_user
from h qualify starts_with(raw_line, '# Query_time:')"""


def _chunks(spark, d):
    """Each slow log as chunks of a hundred line numbers, so that many a query stands in another chunk than its user; no host named."""
    lines = derived(spark, d, "slow_lines")
    chunk = F.lpad(F.floor(F.col("line_no") / 100).cast("string"), 6, "0")
    return lines.withColumn("file_path", F.concat("file_path", F.lit(".log."), chunk))


@query("slow_query_user_chunks", _CHUNKED)
def _(spark, d):
    users = database.with_slow_query_user(_chunks(spark, d), block_lines=50)
    return users.select("host", "line_no", F.coalesce("q_user", F.lit("unknown")).alias("mysql_user"))


@query("slow_query_user_batches", _CHUNKED)
def _(spark, d):
    """The same lines in two batches, the first handing its last users to the second."""
    chunks, out, users = _chunks(spark, d), None, None
    border = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (chunks.filter(F.col("arrival_ts") < border), chunks.filter(F.col("arrival_ts") >= border)):
        found = database.with_slow_query_user(part, before=users).select("host", "line_no", F.coalesce("q_user", F.lit("unknown")).alias("mysql_user"))
        out, users = (found if out is None else out.unionByName(found)), database.last_users(part, users)
    return out


# -- panel, backup, system, toolkit ------------------------------------------------------------------------------

@query("parse_panel_login", f"""with p as (select *, regexp_extract(raw_line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})\\s+(\\S+)\\s+(?:user=(\\S+))?\\s*(?:ip=([\\d.]+))?', ['tm','st','usr','ip']) as g from panel_lines),
  c as (select *, contains(lower(g.st), 'fail') as failed, contains(lower(g.st), 'success') or contains(lower(g.st), 'ok') as good from p where g.tm <> '')
select {ID} as id, cast(g.tm as timestamp) as ts, case when failed then 'warning' else 'info' end as severity, nullif(g.usr, '') as account,
  g.ip as ip_address, 'Panel login of ''' || coalesce(nullif(g.usr, ''), 'unknown')
  || case when failed then ''' failed' else ''' accepted' end || ', address ' || g.ip as message from c where failed or good""")
def _(spark, d):
    return parse(derived(spark, d, "panel_lines"), panel.LOGIN_LOG).select("id", "ts", "severity", "account", "ip_address", "message")


@query("parse_panel_access", f"""with p as (select *, regexp_extract(raw_line, '^([\\d.]+)\\s+.*\\[([^\\]]+)\\]\\s+"(\\S+)\\s+(\\S+)\\s+\\S+"\\s+(\\d{{3}})\\s+(\\d+)', ['ip','tm','method','path','st','size']) as g from panel_lines)
select {ID} as id, arrival_ts as ts, cast(g.st as int) as status_code, case when cast(g.st as int) >= 500 then 'warning' else 'info' end as severity,
  g.ip as ip_address, 'Panel answered ' || g.st || ' to ' || g.method || ' ' || g.path as message from p where g.st <> '' and try_cast(g.st as int) >= 400""")
def _(spark, d):
    return parse(derived(spark, d, "panel_lines"), panel.ACCESS_LOG).select("id", "ts", "status_code", "severity", "ip_address", "message")


@query("parse_panel_error", f"""with p as (select *, regexp_extract(raw_line, '^\\[([^\\]]+)\\]\\s+(\\w+)\\s+(.*)', ['tm','lv','msg']) as g from panel_lines)
select {ID} as id, arrival_ts as ts, case lower(g.lv) when 'error' then 'warning' when 'warn' then 'info' else 'critical' end as severity,
  'cPanel: ' || substr(g.msg, 1, 300) as message from p where lower(g.lv) in ('error', 'crit', 'alert', 'emerg', 'warn')""")
def _(spark, d):
    return parse(derived(spark, d, "panel_lines"), panel.ERROR_LOG).select("id", "ts", "severity", "message")


@query("parse_backup", f"""with c as (select *, case when regexp_matches(raw_line, '(?i)failed|error|abort|cannot|unable|permission denied|disk full|no space') then 'backup_failure'
    when regexp_matches(raw_line, '(?i)warning|skipped|partial|incomplete|retry') then 'backup_warning'
    when regexp_matches(raw_line, '(?i)completed|success|finished|done') then 'backup_success' end as kind,
    nullif(regexp_extract(raw_line, '(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}})', 1), '') as stamp from backup_lines)
select {ID} as id, coalesce(cast(stamp as timestamp), arrival_ts) as ts, stamp is not null as ts_parsed, kind as event_type,
  case kind when 'backup_failure' then 'critical' when 'backup_warning' then 'warning' else 'info' end as severity,
  case kind when 'backup_failure' then 'Backup failure: ' when 'backup_warning' then 'Backup warning: ' else 'Backup completed: ' end || substr(raw_line, 1, 300) as message
from c where kind is not null""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "backup_lines"), "backup").select("id", "ts", "ts_parsed", "event_type", "severity", "message")


@query("parse_system", f"""with p as (select *, regexp_extract(raw_line, {_SYSLOG_RE}) as g from sys_lines),
  t as (select *, case when g.service <> '' then g.msg else raw_line end as txt from p),
  c as (select *, case when regexp_matches(txt, '(?i)Out of memory|oom-killer|oom_kill|Killed process') then 'oom_kill'
    when regexp_matches(txt, '(?i)kernel panic|BUG:|WARNING:|OOPS') then 'kernel_panic'
    when regexp_matches(txt, '(?i)segfault|segmentation fault|general protection fault') then 'segfault'
    when regexp_matches(txt, '(?i)I/O error|disk error|EXT4-fs error|XFS error|read-only') then 'disk_error'
    when regexp_matches(txt, '(?i)Started|Stopped|Restarting|reloading|systemd.*(?:start|stop|restart)') then 'service_change' end as kind from t)
select {ID} as id, case when g.service <> '' then {_SYSLOG_TS} else arrival_ts end as ts, kind as event_type,
  case kind when 'service_change' then 'info' else 'critical' end as severity,
  case kind when 'oom_kill' then 'resource' when 'service_change' then 'service' else 'system' end as category,
  case when g.service <> '' then g.service || ': ' || substr(g.msg, 1, 400) else 'Kernel: ' || substr(raw_line, 1, 400) end as message,
  nullif(g.service, '') as process, try_cast(g.pid as int) as pid from c where kind is not null""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "sys_lines"), "system").select(
        "id", "ts", "event_type", "severity", "category", "message", "process", "pid")


@query("parse_site_toolkit", f"""with c as (select *, case when regexp_matches(raw_line, '(?i)vulnerability|exploit|malware|infected|suspicious') then 'security'
    when regexp_matches(raw_line, '(?i)error|failed|fatal|exception|critical') then 'error'
    when regexp_matches(raw_line, '(?i)warning|deprecated|notice') then 'warning'
    when regexp_matches(raw_line, '(?i)updated|update|upgrade|installed|activated') then 'update' end as kind from kit_lines)
select {ID} as id, case kind when 'security' then 'security' when 'update' then 'system' else 'web' end as category,
  case kind when 'security' then 'critical' when 'error' then 'warning' else 'info' end as severity,
  case kind when 'security' then 'WP Toolkit security: ' when 'error' then 'WP Toolkit error: ' when 'warning' then 'WP Toolkit warning: ' else 'WP Toolkit: ' end || substr(raw_line, 1, 300) as message
from c where kind is not null""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "kit_lines"), "toolkit").select("id", "category", "severity", "message")


# Kept lines per log by the words that decide, counted straight from the raw lines.
_KEPT_SQL = """
  select 'apache_access' as log_name, count(*) as n from access_lines where regexp_matches(raw_line, '" (50\\d|401|403) ')
  union all select 'apache_error', count(*) from error_lines where raw_line not like 'garbage%'
  union all select 'auth_log', count(*) from auth_lines where regexp_matches(raw_line, 'Failed|Accepted|failure|opened')
  union all select 'csf_log', count(*) from fw_lines where raw_line not like '%ok line'
  union all select 'imunify360', count(*) from mal_lines where regexp_matches(raw_line, 'Trojan|quarantined')
  union all select 'mysql_error', count(*) from db_lines
  union all select 'mysql_slow', count(*) from slow_lines where raw_line like '# Query_time%'
  union all select 'cpanel_access', count(*) from panel_lines where regexp_matches(raw_line, 'FAILED|SUCCESS|" [45]00 |\\] (error|CRIT|warn) | OK ip')
  union all select 'backuply', count(*) from backup_lines where raw_line not like 'heartbeat%'
  union all select 'syslog', count(*) from sys_lines where not regexp_matches(raw_line, 'tick|free text')
  union all select 'wptoolkit', count(*) from kit_lines where raw_line <> 'tick'"""


def _stored_lines(spark, d):
    """All lines stored by log name, the layout a fleet's lines are kept in."""
    path = scratch_dir(spark, "lines")
    router.write_lines(derived(spark, d, "all_lines"), path)
    return spark.read.parquet(path)


@query("parse_all", f"select log_name, n from ({_KEPT_SQL}) where n > 0")
def _(spark, d):
    events = router.parse_all(_stored_lines(spark, d))
    return (events.groupBy(F.split_part("log_file", F.lit("/"), F.lit(4)).alias("log_name"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("parse_quality", f"""with kept as ({_KEPT_SQL}), seen as (select log_name, count(*) as lines from all_lines group by all)
select s.log_name, s.lines, k.n as parsed, s.lines - k.n as dropped from seen s join kept k on s.log_name = k.log_name""")
def _(spark, d):
    return router.parse_quality(_stored_lines(spark, d)).drop("parser")


@query("event_defaults", f"""select {ID} as id, arrival_ts as ts, false as ts_parsed, 'security' as source, '/var/log/csf_log/' || split_part(file_path, '/', 5) as log_file
from fw_lines where raw_line not like '%ok line'""")
def _(spark, d):
    return router.parse_lines(derived(spark, d, "fw_lines"), "firewall").select("id", "ts", "ts_parsed", "source", "log_file")


@query("parse_version", """select name, coalesce(nullif(regexp_extract(version_text, '(\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?)', 1), ''),
  nullif(regexp_extract(version_text, '[vV]?(\\d+\\.\\d+)', 1), ''), nullif(substr(trim(split_part(version_text, chr(10), 1)), 1, 50), '')) as version from probes""")
def _(spark, d):
    return derived(spark, d, "probes").select("name", version_number(F.col("version_text")).alias("version"))
