"""Rules, fingerprints, cooldown, incidents, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.correlating import DAY, all_sql, windowed
from checks.inputs import as_of, derived, events
from checks.parsing import _SYSLOG_RE, _SYSLOG_TS, ID
from checks.registry import query
from faultline.catalog import GENERIC_TEXT, PATTERN_TEXTS, RULES, rules_frame, scan_rules
from faultline.config import IncidentConfig, LockoutConfig, NotifyConfig
from faultline.functions.text import render
from faultline.lineage import cut, scratch_dir
from faultline.operators import alerts, correlate, dedup, incidents, rules as rule_ops
from faultline.operators.parsers import router
from faultline.plans import detect

ONE_DAY = IncidentConfig(cooldown_s=86400)
KEYS = ["host", "fingerprint"]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


RULE_ROWS = "(values " + ", ".join(
    f"({_q(r.rule_id)}, {_list(r.categories)}, {_q(r.min_severity)}, {_list(r.keywords)}, {r.base_confidence}::double, {_q(r.summary)}, {_q(r.explanation)})"
    for r in RULES) + ") as r(rule_id, cats, min_severity, kws, conf, summary_t, explanation_t)"
TEXT_ROWS = "(values " + ", ".join(f"({_q(t.pattern)}, {_q(t.severity)}, {_q(t.summary)})" for t in PATTERN_TEXTS) + ") as t(pattern, severity, summary_t)"


def rank(column: str) -> str:
    return f"(case {column} when 'critical' then 2 when 'warning' then 1 else 0 end)"


def matched(source: str = "ev") -> str:
    return f"""select e.*, r.rule_id, r.conf, r.summary_t, r.explanation_t,
  md5(r.rule_id || ':' || coalesce(e.account, '') || ':' || coalesce(e.ip_address, '') || ':' || e.category || ':') as fingerprint
  from {source} e join {RULE_ROWS} on list_contains(r.cats, e.category)
  where e.severity in ('warning', 'critical') and {rank("e.severity")} >= {rank("r.min_severity")}
  and len(list_filter(r.kws, lambda w: contains(lower(e.message || ' ' || e.metadata), w))) > 0"""


def cooled(source: str, gap_s: int) -> str:
    """CTEs that end in ``kept``: host, fingerprint, ts, id, n."""
    return f"""pts as (select host, fingerprint, ts, min(id) as id, count(*) as n from {source} group by host, fingerprint, ts),
chain as (select host, fingerprint, min(ts) as ts from pts group by host, fingerprint
  union all select c.host, c.fingerprint, min(p.ts) from chain c join pts p on p.host = c.host and p.fingerprint = c.fingerprint
    and p.ts >= c.ts + interval {gap_s} seconds group by c.host, c.fingerprint),
spans as (select *, lead(ts) over (partition by host, fingerprint order by ts) as nxt from chain),
kept as (select s.host, s.fingerprint, s.ts, min(p.id) filter (p.ts = s.ts) as id, cast(sum(p.n) as bigint) as n from spans s join pts p
  on p.host = s.host and p.fingerprint = s.fingerprint and p.ts >= s.ts and (s.nxt is null or p.ts < s.nxt) group by s.host, s.fingerprint, s.ts)"""


def filled(template: str, values: dict[str, str]) -> str:
    for name, sql in values.items():
        template = f"replace({template}, '{{{name}}}', {sql})"
    return template


_EVENT_VALUES = {"message": "message", "account": "coalesce(account, 'N/A')", "ip": "coalesce(ip_address, 'N/A')",
                 "domain": "coalesce(domain, 'N/A')", "log_file": "coalesce(nullif(log_file, ''), 'N/A')"}


# -- rules --------------------------------------------------------------------------------------------------------

@query("match_rules", f"select id, rule_id, conf as confidence from ({matched()})")
def _(spark, d):
    return rule_ops.match_rules(events(spark, d), rules_frame(spark)).select("id", "rule_id", F.col("rule_base_confidence").alias("confidence"))


@query("scan_rules", f"select rule_id, count(*) as n from ({matched()}) where rule_id in ('http_500_spike', 'high_cpu') group by rule_id")
def _(spark, d):
    some = scan_rules(spark, "http_500_spike", True).unionByName(scan_rules(spark, "high_cpu"))
    return rule_ops.match_rules(events(spark, d), some).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("rule_overrides", f"""select rule_id, case rule_id when 'high_cpu' then 0.1::double else conf end as confidence, count(*) as n from ({matched()})
  where rule_id <> 'http_500_spike' and (rule_id <> 'csf_block' or severity = 'critical') group by all""")
def _(spark, d):
    overrides = spark.createDataFrame(
        [("high_cpu", None, 0.1, None), ("http_500_spike", False, None, None), ("csf_block", None, None, "critical")],
        "rule_id string, enabled boolean, base_confidence double, min_severity string")
    matches = rule_ops.match_rules(events(spark, d), rule_ops.with_overrides(rules_frame(spark), overrides))
    return matches.groupBy("rule_id", F.col("rule_base_confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("fingerprint", f"select id, rule_id, fingerprint from ({matched()})")
def _(spark, d):
    return incidents.event_candidates(events(spark, d), rules_frame(spark)).select("id", "rule_id", "fingerprint")


@query("render_template", f"""select id, rule_id, {filled("explanation_t", _EVENT_VALUES)} as explanation from ({matched()})""")
def _(spark, d):
    values = {"message": F.col("message"), "account": F.col("account"), "ip": F.col("ip_address"), "domain": F.col("domain"),
              "log_file": F.nullif("log_file", F.lit(""))}
    return rule_ops.match_rules(events(spark, d), rules_frame(spark)).select(
        "id", "rule_id", render(F.col("rule_explanation"), values).alias("explanation"))


# -- cooldown, limits -----------------------------------------------------------------------------------------------

_CAND = "select host, md5(category || ':' || coalesce(account, '')) as fingerprint, ts, id from ev where severity <> 'info'"


def _candidates(spark, d):
    ev = events(spark, d).filter("severity <> 'info'")
    return ev.select("host", F.md5(F.concat("category", F.lit(":"), F.coalesce("account", F.lit("")))).alias("fingerprint"), "ts", "id")


_COOLDOWN_SQL = f"with recursive cand as ({_CAND}), {cooled('cand', 43200)} select host, fingerprint, ts, id, n from kept"


@query("cooldown", _COOLDOWN_SQL)
def _(spark, d):
    return dedup.cooldown(_candidates(spark, d), KEYS, 43200)


@query("cooldown_split_runs", _COOLDOWN_SQL)
def _(spark, d):
    """The way for large groups: cut into runs at long pauses, long runs by jump doubling."""
    return dedup.cooldown(_candidates(spark, d), KEYS, 43200, max_fold=6)


_RESETS = """select md5('web:') as fingerprint, timestamp '2024-01-10 06:00:00' as reset_ts union all select null, timestamp '2024-01-15 09:30:00'
  union all select md5('auth:acct3'), timestamp '2024-01-20 01:00:00'"""


@query("cooldown_reset", f"""with recursive cand0 as ({_CAND}), resets as ({_RESETS}),
  cand as (select host || '#' || (select count(*) from resets r where (r.fingerprint = c.fingerprint or r.fingerprint is null) and r.reset_ts <= c.ts) as host,
    fingerprint, ts, id from cand0 c), {cooled('cand', 86400)} select split_part(host, '#', 1) as host, fingerprint, ts, id from kept""")
def _(spark, d):
    resets = spark.sql(_RESETS.replace("timestamp '", "timestamp_ntz '"))
    candidates = dedup.with_reset_epoch(_candidates(spark, d), resets, "fingerprint")
    return dedup.cooldown(candidates, [*KEYS, "reset_epoch"], 86400).select(*KEYS, "ts", "id")


@query("active_cooldowns", f"""with recursive cand as ({_CAND}), {cooled('cand', 86400)}
  select host, fingerprint, max(ts) as last_created from kept group by host, fingerprint having max(ts) >= (select max(ts) from ev) - interval 1 day""")
def _(spark, d):
    candidates = _candidates(spark, d)
    return dedup.active_cooldowns(dedup.cooldown(candidates, KEYS, 86400), KEYS, as_of(events(spark, d)), 86400)


_RATE = """with recursive a0 as ({source}), num as (select *, row_number() over (partition by {keys} order by ts, id) as rn from a0),
r as (select {keys}, rn, [ts] as live, true as ok, ts, id from num where rn = 1
  union all select {nkeys}, n.rn, case when len(list_filter(r.live, lambda x: x > n.ts - interval {window} seconds)) < {limit}
      then list_append(list_filter(r.live, lambda x: x > n.ts - interval {window} seconds), n.ts)
      else list_filter(r.live, lambda x: x > n.ts - interval {window} seconds) end,
    len(list_filter(r.live, lambda x: x > n.ts - interval {window} seconds)) < {limit}, n.ts, n.id
  from r join num n on {join} and n.rn = r.rn + 1)
"""
_HOST_RATE = _RATE.format(source="select host, ts, id from al", keys="host", nkeys="n.host", join="n.host = r.host", window=86400, limit=10)


@query("rate_limit", _HOST_RATE + "select host, ts, id from r where ok")
def _(spark, d):
    return dedup.rate_limit(derived(spark, d, "al").select("host", "ts", "id"), ["host"], 10, 86400)


@query("rate_limit_split_runs", _HOST_RATE + "select host, ts, id from r where ok")
def _(spark, d):
    """The way for large groups: slices of a run in turn, at most ten timestamps handed on between them."""
    n = derived(spark, d, "al").count()
    return dedup.rate_limit(derived(spark, d, "al").select("host", "ts", "id"), ["host"], 10, 86400, max_fold=max(50, n // 8))


@query("lockout", """with a as (select host, ip_address, ts, id, severity = 'info' as success from ev where category = 'auth'),
  s as (select *, sum(success::int) over (partition by host, ip_address order by ts, id rows between unbounded preceding and current row) as epoch from a),
  f as (select x.id, x.host, x.ip_address, x.ts, count(y.id) as failed from s x left join s y on y.host = x.host and y.ip_address = x.ip_address and y.epoch = x.epoch
    and not y.success and (y.ts, y.id) <= (x.ts, x.id) and y.ts > x.ts - interval 172800 seconds group by all)
select id, failed, greatest(0, 3 - failed) as remaining, failed < 3 as allowed from f""")
def _(spark, d):
    attempts = events(spark, d).filter("category = 'auth'").select("host", "ip_address", "ts", "id", (F.col("severity") == "info").alias("success"))
    return dedup.lockout(attempts, ["host", "ip_address"], LockoutConfig(3, 172800)).select("id", "failed", "remaining", "allowed")


# -- incidents ------------------------------------------------------------------------------------------------------

_FROM_EVENTS = f"""with recursive cand as ({matched()}), {cooled('cand', 86400)},
from_events as (select c.host, c.ts, c.id as event_id, c.rule_id, c.fingerprint, c.severity, c.category, c.account as affected_account, c.ip_address as affected_ip,
  c.conf as confidence_score, substr({filled("c.summary_t", {k: v.replace("message", "c.message") if k == "message" else v.replace("account", "c.account").replace("ip_address", "c.ip_address").replace("domain", "c.domain").replace("log_file", "c.log_file") for k, v in _EVENT_VALUES.items()})}, 1, 300) as summary,
  c.raw_line as evidence, c.log_file as logs, cast(1 as bigint) as occurrence_count, k.n - 1 as suppressed_count
  from cand c join kept k on k.host = c.host and k.fingerprint = c.fingerprint and k.id = c.id)"""


@query("incident_from_event", f"{_FROM_EVENTS} select * from from_events")
def _(spark, d):
    return incidents.incidents_from_events(events(spark, d), rules_frame(spark), ONE_DAY).select(
        "host", "ts", F.array_join("event_ids", ",").alias("event_id"), "rule_id", "fingerprint", "severity", "category", "affected_account",
        "affected_ip", "confidence_score", "summary", F.array_join("source_evidence", "|").alias("evidence"),
        F.array_join("logs_consulted", "|").alias("logs"), "occurrence_count", "suppressed_count")


_CORR_VALUES = {"n": "event_count::varchar", "pattern": "c.pattern", "ip": "coalesce(ip, 'unknown')", "account": "coalesce(account, 'unknown')",
                "areas": "len(string_split(categories, ','))::varchar"}
_CORR = f"""corr as ({all_sql(86400, 86400)}),
first_of as (
  select c.type, c.host, coalesce(c.ip, c.account, c.category) as entity, c.win_start, arg_min(e.category, (e.ts, e.id)) as first_category, min(e.id) as first_id
  from corr c join {windowed(86400, 86400)} e on e.host = c.host and e.win_start = c.win_start
    and ((c.type = 'ip_correlation' and e.ip_address = c.ip) or (c.type = 'account_correlation' and e.account = c.account) or (c.type = 'category_spike' and e.category = c.category))
  group by all),
ccand as (select c.host, c.win_start + interval 86400 seconds as ts, 'corr_' || c.pattern as rule_id,
  md5('corr_' || c.pattern || ':' || coalesce(account, '') || ':' || coalesce(ip, '') || ':' || coalesce(category, '') || ':') as fingerprint,
  coalesce(t.severity, 'warning') as severity, coalesce(c.category, f.first_category) as category, account as affected_account, ip as affected_ip,
  confidence as confidence_score, {filled(f"coalesce(t.summary_t, {_q(GENERIC_TEXT.summary)})", _CORR_VALUES)} as summary, event_count as occurrence_count,
  c.host || c.type || c.pattern || coalesce(c.ip, c.account, c.category) || c.win_start as id
  from corr c left join {TEXT_ROWS} on t.pattern = c.pattern
  join first_of f on f.type = c.type and f.host = c.host and f.win_start = c.win_start and f.entity = coalesce(c.ip, c.account, c.category))"""


@query("incident_from_correlation", f"with {_CORR} select * exclude (id) from ccand")
def _(spark, d):
    ev = events(spark, d)
    cooled = incidents.cool_correlations(correlate.correlate_all(ev, DAY), ONE_DAY)
    found = correlate.with_evidence(cooled, ev, DAY)
    return incidents.incidents_from_correlations(found, ONE_DAY).select(
        "host", "ts", "rule_id", "fingerprint", "severity", "category", "affected_account", "affected_ip", "confidence_score", "summary", "occurrence_count")


_SHOWN = ("host", "fingerprint", "rule_id", "severity", "category", "first_ts", "last_ts", "occurrence_count", "affected_account", "affected_ip")


def _detect_sql() -> str:
    return f"""{_FROM_EVENTS}, {_CORR}, {cooled('ccand', 86400).replace('pts', 'cpts').replace('chain', 'cchain').replace('spans', 'cspans').replace('kept', 'ckept')},
both_kinds as (select host, fingerprint, rule_id, severity, category, ts, event_id as id, occurrence_count, affected_account, affected_ip from from_events
  union all select c.host, c.fingerprint, c.rule_id, c.severity, c.category, c.ts, c.id, c.occurrence_count, c.affected_account, c.affected_ip
  from ccand c join ckept k on k.host = c.host and k.fingerprint = c.fingerprint and k.id = c.id)
"""


@query("union_incidents", _detect_sql() + "select host, rule_id, severity, count(*) as n from both_kinds group by all")
def _(spark, d):
    return (detect.candidate_incidents(events(spark, d), rules_frame(spark), DAY, ONE_DAY).groupBy("host", "rule_id", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


@query("detect_incidents", _detect_sql() + """select host, fingerprint, arg_min(rule_id, ts) as rule_id, arg_min(severity, ts) as severity, arg_min(category, ts) as category,
  min(ts) as first_ts, max(ts) as last_ts, cast(arg_min(occurrence_count, ts) + count(*) - 1 as bigint) as occurrence_count,
  any_value(affected_account) as affected_account, any_value(affected_ip) as affected_ip from both_kinds group by host, fingerprint""")
def _(spark, d):
    return detect.detect_incidents(events(spark, d), rules_frame(spark), None, DAY, ONE_DAY).select(*_SHOWN)


_SNAP_EVENTS = """(select host, ts, sha256(host || '|' || metric || '|' || ts) as id, 'resource' as category, cast(null as varchar) as account, cast(null as varchar) as ip_address,
  case when value >= c then 'critical' else 'warning' end as severity,
  case metric when 'cpu' then 'CPU usage' when 'memory' then 'Memory usage' when 'disk' then 'Disk space' else 'Load average' end as message, '{"metric":"' || metric || '"}' as metadata
  from (select host, ts, 'cpu' as metric, cpu_percent as value, 80.0 as w, 95.0 as c from snap
    union all select host, ts, 'memory', memory_percent, 85.0, 95.0 from snap union all select host, ts, 'disk', disk_percent, 85.0, 95.0 from snap
    union all select host, ts, 'load', load_1, 2.0 * cpu_count, 4.0 * cpu_count from snap) where value >= w)"""


@query("resource_incidents", f"""with recursive sev as (select * from {_SNAP_EVENTS}), cand as ({matched('sev')}), {cooled('cand', 86400)},
  i as (select c.* from cand c join kept k on k.host = c.host and k.fingerprint = c.fingerprint and k.id = c.id)
select host, fingerprint, any_value(rule_id) as rule_id, arg_min(severity, ts) as severity, min(ts) as first_ts, max(ts) as last_ts, count(*) as occurrence_count
from i group by host, fingerprint""")
def _(spark, d):
    return detect.resource_incidents(derived(spark, d, "snap"), rules_frame(spark), inc=ONE_DAY).select(
        "host", "fingerprint", "rule_id", "severity", "first_ts", "last_ts", "occurrence_count")


@query("resource_incidents_batches", f"""with recursive sev as (select * from {_SNAP_EVENTS}), cand as ({matched('sev')}), {cooled('cand', 86400)},
  i as (select c.*, k.n from cand c join kept k on k.host = c.host and k.fingerprint = c.fingerprint and k.id = c.id)
select host, fingerprint, min(ts) as first_ts, max(ts) as last_ts, count(*) as occurrence_count, cast(sum(n) - count(*) as bigint) as suppressed_count
from i group by host, fingerprint""")
def _(spark, d):
    """The samples in three batches: cooldowns and counts go on over their borders as if they were one."""
    snap, table, start = derived(spark, d, "snap"), None, "1970-01-01"
    for end in ("2024-01-09 05:00:00", "2024-01-20 11:30:00", "2999-01-01"):
        part = snap.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        table, start = cut(detect.resource_incidents(part, rules_frame(spark), table, inc=ONE_DAY)), end
    return table.select("host", "fingerprint", "first_ts", "last_ts", "occurrence_count", "suppressed_count")


_AUTH_EVENTS = f"""lp as (select *, regexp_extract(raw_line, {_SYSLOG_RE}) as g from auth_lines),
  lc as (select *, regexp_matches(g.msg, '(?i)Failed password|authentication failure|FAILED LOGIN|invalid user') as failed,
    regexp_matches(g.msg, '(?i)Accepted password|session opened|Successful login') as accepted,
    regexp_extract(g.msg, 'from\\s+(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) as ip, regexp_extract(g.msg, '(?:for|user[= ])\\s?(\\S+)', 1) as usr from lp where g.service <> ''),
  le as (select {ID} as id, host, coalesce({_SYSLOG_TS}, arrival_ts) as ts, 'auth' as category, case when failed then 'warning' else 'info' end as severity,
    'Login of ''' || usr || ''' through ' || g.service || case when failed then ' failed' else ' accepted' end || ', address ' || ip as message,
    ip as ip_address, nullif(usr, '') as account, '"auth_result":"' || case when failed then 'failed' else 'success' end || '"' as metadata from lc where failed or accepted)"""


LOGIN_INCIDENTS = f"""with recursive {_AUTH_EVENTS}, cand as ({matched('le')}), {cooled('cand', 86400)},
  i as (select c.*, k.n from cand c join kept k on k.host = c.host and k.fingerprint = c.fingerprint and k.id = c.id)
select host, fingerprint, any_value(rule_id) as rule_id, arg_min(severity, ts) as severity, min(ts) as first_ts, max(ts) as last_ts, count(*) as occurrence_count,
  cast(sum(n) - count(*) as bigint) as suppressed_count, any_value(account) as affected_account, any_value(ip_address) as affected_ip from i group by host, fingerprint"""


@query("lines_to_incidents", LOGIN_INCIDENTS)
def _(spark, d):
    """All logs, parsed, enriched, stored, correlated and matched in one run; compared are the incidents of the login log."""
    return login_incidents(lines_run(spark, d))


def login_incidents(found):
    logins = found.filter((F.col("category") == "auth") & (F.col("affected_service") == "security") & ~F.col("rule_id").startswith("corr_"))
    return logins.select("host", "fingerprint", "rule_id", "severity", "first_ts", "last_ts", "occurrence_count", "suppressed_count", "affected_account", "affected_ip")


def lines_run(spark, d):
    path = scratch_dir(spark, "lines")
    router.write_lines(derived(spark, d, "all_lines"), path)
    lines = spark.read.parquet(path)
    return detect.lines_to_incidents(lines, derived(spark, d, "domains"), derived(spark, d, "users"), rules_frame(spark), scratch_dir(spark, "events"),
                                     None, DAY, ONE_DAY)


# rows of one host without its name: they are the host ''
_NO_HOST = "(select * replace (case when host = 'host0' then '' else host end as host) from {})"


def _nameless(df):
    return df.withColumn("host", F.when(F.col("host") != "host0", F.col("host")))


@query("incident_from_event_null_host", f"with recursive cand as ({matched(_NO_HOST.format('ev'))}), {cooled('cand', 86400)} select host, fingerprint, ts, id as event_id, n - 1 as suppressed_count from kept")
def _(spark, d):
    found = incidents.incidents_from_events(_nameless(events(spark, d)), rules_frame(spark), ONE_DAY)
    return found.select("host", "fingerprint", "ts", F.try_element_at("event_ids", F.lit(1)).alias("event_id"), "suppressed_count")


@query("corr_evidence_null_host", f"""with corr as ({all_sql(86400, 86400)}), hit as (select c.type, c.pattern, c.win_start, c.host, e.id,
    row_number() over (partition by c.type, c.host, coalesce(c.ip, c.account, c.category), c.win_start order by e.ts, e.id) as rn, coalesce(c.ip, c.account, c.category) as entity
    from corr c join {windowed(86400, 86400)} e on e.host = c.host and e.win_start = c.win_start
    and ((c.type = 'ip_correlation' and e.ip_address = c.ip) or (c.type = 'account_correlation' and e.account = c.account) or (c.type = 'category_spike' and e.category = c.category)))
select type, pattern, win_start, case when host = 'host0' then '' else host end as host, entity, string_agg(id, ',' order by rn) as ids from hit where rn <= 20 group by all""")
def _(spark, d):
    """All kinds of correlation in one pass, their evidence in another."""
    ev = _nameless(events(spark, d))
    found = correlate.with_evidence(cut(correlate.correlate_all(ev, DAY)), ev, DAY)
    return found.select("type", "pattern", "win_start", "host", F.coalesce("ip", "account", "category").alias("entity"),
                        F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("ids"))


def _old_new(spark, d):
    inc = derived(spark, d, "inc")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    return inc.filter(F.col("ts") < cut), inc.filter(F.col("ts") >= cut)


_OLD_NEW = """with old as (select * from inc where ts < timestamp '2024-01-10'), new as (select * from inc where ts >= timestamp '2024-01-10'),
  active as (select * from (select *, row_number() over (partition by host, fingerprint order by ts desc, id desc) as rn from old
    where state in ('new','acknowledged','investigating')) where rn = 1)"""


@query("match_active_incident", _OLD_NEW + " select n.id, a.id as active_id from new n left join active a on a.host = n.host and a.fingerprint = n.fingerprint")
def _(spark, d):
    old, new = _old_new(spark, d)
    return incidents.match_active(new, old).select("id", "active_id")


@query("merge_occurrences", _OLD_NEW + """, s as (select host, fingerprint, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, sum(suppressed_count) as sup,
    arg_min(id, (ts, id)) as id from new group by host, fingerprint)
select o.id, cast(o.occurrence_count + coalesce(s.n, 0) as bigint) as occurrence_count, cast(o.suppressed_count + coalesce(s.sup, 0) as bigint) as suppressed_count, coalesce(s.last_ts, o.updated_at) as updated_at
  from old o left join active a on a.id = o.id left join s on a.id is not null and s.host = a.host and s.fingerprint = a.fingerprint
union all select s.id, cast(n.occurrence_count + s.n - 1 as bigint), cast(s.sup as bigint), s.last_ts from s join new n on n.id = s.id
  where not exists (select 1 from active a where a.host = s.host and a.fingerprint = s.fingerprint)""")
def _(spark, d):
    old, new = _old_new(spark, d)
    return incidents.merge_occurrences(new, old).select("id", "occurrence_count", "suppressed_count", "updated_at")


@query("merge_occurrences_null_host", _OLD_NEW.replace("from inc where", f"from {_NO_HOST.format('inc')} where") + """, s as (select host, fingerprint, max(ts) as last_ts, count(*) as n from new group by host, fingerprint)
select o.id, cast(o.occurrence_count + coalesce(s.n, 0) as bigint) as occurrence_count, coalesce(s.last_ts, o.updated_at) as updated_at
  from old o left join active a on a.id = o.id left join s on a.id is not null and s.host = a.host and s.fingerprint = a.fingerprint""")
def _(spark, d):
    old, new = _old_new(spark, d)
    merged = incidents.merge_occurrences(_nameless(new), _nameless(old))
    return merged.join(old.select("id"), "id", "left_semi").select("id", "occurrence_count", "updated_at")


# -- alerts -----------------------------------------------------------------------------------------------------------

@query("incident_to_alert", """select sha256('alert|' || id) as id, id as incident_id, ts, severity, category, summary as title, explanation as message,
  case when coalesce(affected_account, '') <> '' then affected_account when coalesce(affected_ip, '') <> '' then affected_ip when coalesce(affected_service, '') <> '' then affected_service else 'unknown' end as affected_entity,
  suggested_remediation as recommended_action, false as acknowledged from inc""")
def _(spark, d):
    return alerts.to_alerts(derived(spark, d, "inc")).select(
        "id", "incident_id", "ts", "severity", "category", "title", "message", "affected_entity", "recommended_action", "acknowledged")


@query("notify_fanout", _RATE.format(
    source="select host, ch as channel, ts, id from al, (values ('dashboard'), ('email')) c(ch)", keys="host, channel",
    nkeys="n.host, n.channel", join="n.host = r.host and n.channel = r.channel", window=86400, limit=10)
    + "select host, channel, id as alert_id, case when ok then 'sent' else 'limited' end as status from r")
def _(spark, d):
    cfg = NotifyConfig(channels=("dashboard", "email"), rate_limit=10, rate_window_s=86400)
    return alerts.deliveries(derived(spark, d, "al"), cfg).select("host", "channel", "alert_id", "status")


@query("webhook_payload", """select sha256('alert|' || id) as id, severity, summary as title, raw_line_2 as second_evidence, 3 as evidence_count
  from (select *, list_extract(source_evidence, 2) as raw_line_2 from inc)""")
def _(spark, d):
    made = alerts.webhook_payload(alerts.to_alerts(derived(spark, d, "inc")))
    return made.select(
        "id", F.get_json_object("payload", "$.severity").alias("severity"), F.get_json_object("payload", "$.title").alias("title"),
        F.get_json_object("payload", "$.evidence[1]").alias("second_evidence"),
        F.json_array_length(F.get_json_object("payload", "$.evidence")).alias("evidence_count"))


@query("latest_pending", "select id, ts from al order by ts desc, id desc limit 100")
def _(spark, d):
    return alerts.latest_pending(derived(spark, d, "al")).select("id", "ts")
