"""Read side: filters, pages, counts, samples, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import as_of, derived, events, table
from checks.registry import query
from faultline.config import DeclaredLimits
from faultline.config import Thresholds
from faultline.functions.times import age_label
from faultline.lineage import cut, scratch_dir
from faultline.operators import enrich, incidents as inc_ops, lifecycle, metrics, views
from faultline.sources import accounts as account_files

EV = "id, ts, host, category, severity, account, domain, ip_address"
EV_COLS = EV.split(", ")


# -- filters ----------------------------------------------------------------------------------------------------

@query("scan_events_table", f"""select {EV} from ev where category = 'security' and severity = 'warning'
  and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'""")
def _(spark, d):
    return views.filter_events(events(spark, d), category="security", severity="warning",
                               since="2024-01-05 00:00:00", until="2024-01-20 00:00:00").select(*EV_COLS)


@query("filter_events", f"""select {EV} from ev where source = 'web' and account = 'acct7' and ip_address = '10.0.0.17'
  union all select {EV} from ev where severity = 'critical' and domain = 'site3.com'""")
def _(spark, d):
    ev = events(spark, d)
    return (views.filter_events(ev, source="web", account="acct7", ip_address="10.0.0.17")
            .unionByName(views.filter_events(ev, severity="critical", domain="site3.com")).select(*EV_COLS))


@query("filter_incidents", """select id, ts, state, severity, category from inc
  where state = 'investigating' and severity = 'critical' and ts >= timestamp '2024-01-10'""")
def _(spark, d):
    return views.filter_incidents(derived(spark, d, "inc"), state="investigating", severity="critical",
                                  since="2024-01-10 00:00:00").select("id", "ts", "state", "severity", "category")


@query("filter_alerts", "select id, ts, severity from al where severity = 'warning' and not acknowledged and not suppressed")
def _(spark, d):
    return views.filter_alerts(derived(spark, d, "al"), "warning", False).select("id", "ts", "severity")


@query("events_since", f"select {EV} from ev where ts >= timestamp '2024-01-25' and source = 'auth' order by ts desc, id desc")
def _(spark, d):
    return views.events_since(events(spark, d), "2024-01-25 00:00:00", "auth").select(*EV_COLS)


@query("actionable_events", f"select {EV} from ev where severity in ('warning', 'critical')")
def _(spark, d):
    from faultline.functions.severity import actionable
    return events(spark, d).filter(actionable(F.col("severity"))).select(*EV_COLS)


@query("severity_at_least", """select a.category, b.m as minimum, count(*) as n from ev a, (values ('info', 0), ('warning', 1), ('critical', 2)) as b(m, r)
  where (case a.severity when 'critical' then 2 when 'warning' then 1 else 0 end) >= b.r group by all""")
def _(spark, d):
    from faultline.functions.severity import at_least
    levels = F.explode(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")))
    return (events(spark, d).select("category", "severity", levels.alias("minimum"))
            .filter(at_least(F.col("severity"), F.col("minimum"))).groupBy("category", "minimum")
            .agg(F.count(F.lit(1)).alias("n")))


@query("keyword_any", """select id, category from ev where contains(lower(message), 'suspicious') or contains(lower(message), 'oom')
  or contains(lower(metadata), '"k":50') or contains(lower(metadata), 'oom')""")
def _(spark, d):
    from faultline.functions.text import contains_any
    text = F.lower(F.concat_ws(" ", "message", "metadata"))
    return events(spark, d).filter(contains_any(text, ("suspicious", "oom", '"k":50'))).select("id", "category")


@query("active_incidents", "select id, state from inc where state in ('new', 'acknowledged', 'investigating')")
def _(spark, d):
    return views.active_incidents(derived(spark, d, "inc")).select("id", "state")


@query("domain_pages", f"""select 'database' as page, {EV} from (select * from ev where category = 'database' order by ts desc, id desc limit 50)
  union all select 'backups', {EV} from (select * from ev where category = 'backup' order by ts desc, id desc limit 50)
  union all select 'security', {EV} from (select * from ev where category = 'security' order by ts desc, id desc limit 50)
  union all select 'security', {EV} from (select * from ev where category = 'malware' order by ts desc, id desc limit 20)""")
def _(spark, d):
    ev = events(spark, d)
    out = None
    for name in views.DOMAIN_PAGES:
        part = views.domain_page(ev, name).select(F.lit(name).alias("page"), *EV_COLS)
        out = part if out is None else out.unionByName(part)
    return out


@query("long_running_queries", """select host, ts, pid, "user", time from dbprocs
  where command <> 'Sleep' and "user" not in ('system user', 'root', 'event_scheduler')""")
def _(spark, d):
    return metrics.long_running(derived(spark, d, "dbprocs")).select("host", "ts", "pid", "user", "time")


@query("incident_by_id", """select id, state, severity, list_extract(source_evidence, 2) as second_evidence, json_extract_string(metadata, '$.k') as k
  from inc where id = (select min(id) from inc)""")
def _(spark, d):
    inc = derived(spark, d, "inc")
    first = inc.agg(F.min("id")).first()[0]
    return views.by_id(inc, first).select(
        "id", "state", "severity", F.try_element_at("source_evidence", F.lit(2)).alias("second_evidence"),
        F.get_json_object("metadata", "$.k").alias("k"))


@query("slow_flag", "select pid, time, time > 5 as slow from dbprocs")
def _(spark, d):
    return metrics.slow_flag(derived(spark, d, "dbprocs")).select("pid", "time", "slow")


# -- samples and classes ------------------------------------------------------------------------------------------

_GAUGES = """select host, ts, 'cpu' as metric, cpu_percent as value, 80.0 as w, 95.0 as c from snap
  union all select host, ts, 'memory', memory_percent, 85.0, 95.0 from snap union all select host, ts, 'disk', disk_percent, 85.0, 95.0 from snap
  union all select host, ts, 'load', load_1, 2.0 * cpu_count, 4.0 * cpu_count from snap"""


@query("threshold_events", f"""select host, ts, metric, cast(value as double) as value, case when value >= c then 'critical' else 'warning' end as severity
  from ({_GAUGES}) where value >= w""")
def _(spark, d):
    return metrics.threshold_rows(derived(spark, d, "snap")).select("host", "ts", "metric", "value", "severity")


@query("inode_threshold", """select host, ts, disk_inodes_used_percent as value, case when disk_inodes_used_percent >= 95 then 'critical' else 'warning' end as severity
  from snap where disk_inodes_used_percent >= 85""")
def _(spark, d):
    rows = metrics.threshold_rows(derived(spark, d, "snap"), Thresholds(check_inodes=True))
    return rows.filter("metric = 'inodes'").select("host", "ts", "value", "severity")


_HEALTH = """with al_n as (select count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'warning') as w from al),
  s as (select * from snap order by ts desc, host desc limit 1)
select case when c > 0 or cpu_percent > 95 or memory_percent > 95 or disk_percent > 95 then 'critical'
  when w > 0 or cpu_percent > 80 or memory_percent > 85 or disk_percent > 85 then 'warning' else 'healthy' end as server_health,
  cpu_percent, memory_percent, disk_percent from al_n, s"""


@query("server_health", _HEALTH)
def _(spark, d):
    row = views.one_row(views.alert_stats(derived(spark, d, "al")), views.latest_gauges(derived(spark, d, "snap")))
    return row.select(views.server_health().alias("server_health"), "cpu_percent", "memory_percent", "disk_percent")


@query("service_health", """select host, name, case when not installed then 'not_installed' when running then 'healthy' else 'down' end as health from probes""")
def _(spark, d):
    return metrics.service_health(derived(spark, d, "probes")).select("host", "name", "health")


@query("usage_band", """select event_id, cpu_percent, case when cpu_percent >= 90 then 'danger' when cpu_percent >= 75 then 'warning' else 'success' end as band,
  least(100.0, cpu_percent * 1.2)::double as width from snap""")
def _(spark, d):
    return derived(spark, d, "snap").select(
        "event_id", "cpu_percent", metrics.usage_band(F.col("cpu_percent")).alias("band"),
        metrics.bar_width(F.col("cpu_percent") * 1.2).alias("width"))


@query("relative_age", """with n as (select max(ts) as now from ev), a as (select id, cast(floor((epoch_us(now) - epoch_us(ts)) / 1000000) as bigint) as s from ev, n)
select id, case when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' else s // 86400 || 'd ago' end as age from a""")
def _(spark, d):
    ev = events(spark, d)
    return ev.select("id", age_label(F.col("ts"), as_of(ev)).alias("age"))


# -- joins ------------------------------------------------------------------------------------------------------

@query("enrich_domain", """select e.id, coalesce(e.account, m.account) as account from ev e left join domains m on lower(e.domain) = m.domain""")
def _(spark, d):
    return enrich.enrich_domain(events(spark, d), derived(spark, d, "domains")).select("id", "account")


@query("enrich_mysql_user", """select e.id, coalesce(e.account, x.account, p.account) as account from ev e
  left join users x on e.mysql_user = x.mysql_user
  left join users p on contains(e.mysql_user, '_') and split_part(e.mysql_user, '_', 1) = p.mysql_user""")
def _(spark, d):
    names = derived(spark, d, "accounts")
    return enrich.enrich_mysql_user(events(spark, d), enrich.mysql_user_map(names), names).select("id", "account")


@query("enrich_process_user", """select p.pid, p."user", a.username as account from procs p left join accounts a on p."user" = a.username""")
def _(spark, d):
    return enrich.process_owner(derived(spark, d, "procs"), derived(spark, d, "accounts")).select("pid", "user", "account")


@query("account_domains", "select distinct account, domain from domains")
def _(spark, d):
    return enrich.account_domains(derived(spark, d, "domains"))


@query("ip_domains", "select distinct a.ip, m.domain from accounts a join domains m on a.username = m.account")
def _(spark, d):
    return enrich.ip_domains(derived(spark, d, "accounts"), derived(spark, d, "domains"))


@query("mysql_user_map", "select distinct username as mysql_user, username as account from accounts")
def _(spark, d):
    return enrich.mysql_user_map(derived(spark, d, "accounts"))


@query("account_inventory", "select count(distinct username) as account_count, (select count(distinct domain) from domains) as domain_count from accounts")
def _(spark, d):
    return enrich.account_inventory(derived(spark, d, "accounts"), derived(spark, d, "domains"))


@query("alert_to_incident", "select a.id, a.severity, i.state as incident_state, i.rule_id from al a left join inc i on a.incident_id = i.id")
def _(spark, d):
    from faultline.operators.alerts import with_incident
    return with_incident(derived(spark, d, "al"), derived(spark, d, "inc")).select("id", "severity", "incident_state", "rule_id")


@query("snapshot_merge", """with db as (select 'host' || (user_id % 2) as host, time_bucket(interval 3600 seconds, ts) as c, arg_max(k, ts) as k, arg_max(value, ts) as v from base group by all)
select s.host, s.ts, s.cpu_percent, db.k as db_connections, db.v as db_queries_sec from snap s left join db on s.host = db.host and time_bucket(interval 3600 seconds, s.ts) = db.c""")
def _(spark, d):
    db = derived(spark, d, "base").select(F.concat(F.lit("host"), F.col("user_id") % 2).alias("host"), "ts",
                                          F.col("k").alias("db_connections"), F.col("value").alias("db_queries_sec"))
    return metrics.merge_cycle(derived(spark, d, "snap"), db, 3600).select(
        "host", "ts", "cpu_percent", "db_connections", "db_queries_sec")


@query("incident_events", """select i.id as incident_id, e.id, e.category, e.message from (select id, unnest(event_ids) as eid from inc) i join ev e on i.eid = e.id""")
def _(spark, d):
    return inc_ops.incident_events(derived(spark, d, "inc"), events(spark, d)).select("incident_id", "id", "category", "message")


# -- account files ------------------------------------------------------------------------------------------------

_MAP_LINES = """select c_custkey as line_no, case c_custkey % 6 when 0 then '# comment ' || c_custkey when 1 then '   '
  when 2 then 'Site' || c_custkey || '.COM: acct' || (c_custkey % 40) when 3 then '*: nobody' when 4 then 'site' || c_custkey || '.org: *'
  else 'SHARED.net:acct' || c_custkey end as value, 'userdomains' as file_name from customer"""


@query("scan_domain_map", f"""with l as ({_MAP_LINES}), p as (select line_no, lower(trim(split_part(value, ':', 1))) as domain, trim(substr(value, strpos(value, ':') + 1)) as account
    from l where contains(value, ':') and not starts_with(trim(value), '#'))
select domain, account, line_no from p where domain <> '' and account <> '' and account <> '*'""")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return account_files.domain_map(spark.sql(_MAP_LINES), drop_wildcard=True)


@query("union_domain_maps", f"""with l as ({_MAP_LINES}), p as (select line_no, lower(trim(split_part(value, ':', 1))) as domain, trim(substr(value, strpos(value, ':') + 1)) as account
    from l where contains(value, ':') and not starts_with(trim(value), '#')),
  a as (select 0 as pr, domain, account from domains union all
        select 1, domain, arg_max(account, line_no) from p where domain <> '' and account <> '' and account <> '*' group by domain)
select domain, arg_max(account, pr) as account from a group by domain""")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    second = account_files.last_wins(account_files.domain_map(spark.sql(_MAP_LINES), drop_wildcard=True))
    return enrich.merge_domain_maps(derived(spark, d, "domains"), second)


_FILE_LINES = """select case when c_custkey % 50 = 49 then '.hidden' else 'user' || (c_custkey % 200) end as file_name, c_custkey * 10 + f as line_no,
  case f when 0 then 'DNS=Site' || c_custkey || '.com' when 1 then 'IP=10.2.0.' || (c_custkey % 9) when 2 then 'PLAN=' || c_mktsegment
         when 3 then 'SUSPENDED=' || (c_custkey % 2) else 'NOISE' end as value
  from customer cross join (select 0 as f union all select 1 union all select 2 union all select 3 union all select 4) fs"""


@query("scan_account_files", f"""with l as ({_FILE_LINES}) select file_name as username,
  arg_max(value, line_no) filter (value like 'IP=%')[4:] as ip, arg_max(value, line_no) filter (value like 'PLAN=%')[6:] as plan,
  arg_max(value, line_no) filter (value like 'SUSPENDED=%') = 'SUSPENDED=1' as suspended, count(*) filter (value like 'DNS=%') as dns_entries
  from l where file_name not like '.%' group by file_name""")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return account_files.accounts(spark.sql(_FILE_LINES))


@query("scan_account_dns", f"""with l as ({_FILE_LINES}) select distinct lower(value[5:]) as domain, file_name as account
  from l where file_name not like '.%' and value like 'DNS=%'""")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return account_files.account_dns(spark.sql(_FILE_LINES))


@query("scan_status_counters", """select 'host' || (user_id % 2) as host, ts, max(cast(event_id * 10 as bigint)) as "Questions", max(cast(k as bigint)) as "Threads_connected" from base group by all""")
def _(spark, d):
    base = derived(spark, d, "base")
    lines = base.select(F.concat(F.lit("host"), F.col("user_id") % 2).alias("host"), "ts", F.explode(F.array(
        F.concat(F.lit("Questions\t"), F.col("event_id") * 10), F.concat(F.lit("Threads_connected  "), "k"), F.lit("broken"))).alias("value"))
    return metrics.status_counters(lines)


# -- aggregates ---------------------------------------------------------------------------------------------------

@query("count_by_severity", """select t.table_name, s.severity, coalesce(c.n, 0) as n from (values ('events'), ('incidents'), ('alerts')) t(table_name)
  cross join (values ('info'), ('warning'), ('critical')) s(severity)
  left join (select 'events' as table_name, severity, count(*) as n from ev group by all union all select 'incidents', severity, count(*) from inc group by all
             union all select 'alerts', severity, count(*) from al group by all) c on c.table_name = t.table_name and c.severity = s.severity""")
def _(spark, d):
    return views.count_by_severity(events=events(spark, d), incidents=derived(spark, d, "inc"), alerts=derived(spark, d, "al"))


@query("count_active", "select count(*) as active_incidents from inc where state in ('new','acknowledged','investigating')")
def _(spark, d):
    return views.incident_stats(derived(spark, d, "inc")).select("active_incidents")


@query("count_unacked", "select count(*) as unack_alerts from al where not acknowledged and not suppressed")
def _(spark, d):
    return views.alert_stats(derived(spark, d, "al")).select("unack_alerts")


@query("events_last_hour", "select count(*) as events_last_hour from ev where ts >= (select max(ts) from ev) - interval 1 hour")
def _(spark, d):
    ev = events(spark, d)
    return views.event_stats(ev, as_of(ev)).select("events_last_hour")


@query("total_count", "select count(*) as total from ev where category = 'web'")
def _(spark, d):
    return views.total(views.filter_events(events(spark, d), category="web"))


def _bucket_sql(width: str, hours: int) -> str:
    return f"""select host, time_bucket(interval {width}, ts) as ts, round(avg(cpu_percent), 6) as cpu_percent, round(avg(memory_percent), 6) as memory_percent,
  round(avg(disk_percent), 6) as disk_percent, round(avg(load_1), 6) as load_1, round(avg(db_connections), 6) as db_connections, {hours} as hours
  from snap where ts >= (select max(ts) from snap) - interval {hours} hours group by host, time_bucket(interval {width}, ts)"""


@query("downsample_snapshots", " union all ".join(
    _bucket_sql(w, h) for w, h in (("1 minute", 1), ("5 minutes", 24), ("1 hour", 168), ("6 hours", 720))))
def _(spark, d):
    snap = derived(spark, d, "snap")
    now, out = as_of(snap), None
    for hours in metrics.RANGES.values():
        part = metrics.downsample(snap, hours, now).select(
            "host", "ts", *[F.round(g, 6).alias(g) for g in metrics.CHART_GAUGES], F.lit(hours).alias("hours"))
        out = part if out is None else out.unionByName(part)
    return out


@query("page_counts", """select count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, count(*) filter (not acknowledged) as unacknowledged
  from (select * from al where not suppressed order by ts desc, id desc limit 50)""")
def _(spark, d):
    return views.page_counts(views.page(views.filter_alerts(derived(spark, d, "al")), 50))


SUMMARY = """with e as (select count(*) filter (severity = 'info') as events_info, count(*) filter (severity = 'warning') as events_warning, count(*) filter (severity = 'critical') as events_critical,
    count(*) filter (ts >= (select max(ts) from ev) - interval 1 hour) as events_last_hour from ev),
  i as (select count(*) filter (state in ('new','acknowledged','investigating')) as active_incidents from inc),
  a as (select count(*) as alerts_total, count(*) filter (severity = 'critical') as c, count(*) filter (not acknowledged and not suppressed) as unack_alerts from al),
  v as (select count(*) as services_total, count(*) filter (running) as services_healthy from probes),
  s as (select * from snap order by ts desc, host desc limit 1),
  r as (select string_agg(id, ',' order by ts desc, id desc) as recent from (select * from inc order by ts desc, id desc limit 5))
select e.*, active_incidents, alerts_total, unack_alerts, services_total, services_healthy, cpu_percent, recent,
  case when c > 0 then 'critical' else 'other' end as server_health from e, i, a, v, s, r"""


def shown_summary(row):
    return row.select("events_info", "events_warning", "events_critical", "events_last_hour", "active_incidents", "alerts_total",
                      "unack_alerts", "services_total", "services_healthy", "cpu_percent", "server_health",
                      F.array_join(F.transform("recent_incidents", lambda x: x["id"]), ",").alias("recent"))


@query("summary", SUMMARY)
def _(spark, d):
    ev = events(spark, d)
    row = views.summary(ev, derived(spark, d, "inc"), derived(spark, d, "al"), derived(spark, d, "snap"),
                        metrics.service_health(derived(spark, d, "probes")), as_of(ev))
    return shown_summary(row)


@query("qps_delta", """with c as (select host, ts, event_id * 10 + (case when event_id % 500 >= 250 then 0 else 100000 end) as q from snap),
  p as (select *, lag(q) over w as pq, lag(ts) over w as pt from c window w as (partition by host order by ts))
select host, ts, case when q >= pq and ts > pt then round((q - pq) / ((epoch_us(ts) - epoch_us(pt)) / 1000000.0), 6) end as qps from p""")
def _(spark, d):
    snap = derived(spark, d, "snap").select("host", "ts", (F.col("event_id") * 10 + F.when(
        F.col("event_id") % 500 >= 250, 0).otherwise(100000)).alias("questions"))
    return metrics.queries_per_second(snap).select("host", "ts", F.round("qps", 6).alias("qps"))


@query("qps_delta_null_host", """with c as (select host, ts, event_id * 10 + (case when event_id % 500 >= 250 then 0 else 100000 end) as q from snap),
  p as (select *, lag(q) over w as pq, lag(ts) over w as pt from c window w as (partition by host order by ts))
select host, ts, case when q >= pq and ts > pt then round((q - pq) / ((epoch_us(ts) - epoch_us(pt)) / 1000000.0), 6) end as qps from p""")
def _(spark, d):
    snap = derived(spark, d, "snap").select(F.when(F.col("host") != "host0", F.col("host")).alias("host"), "ts", (F.col("event_id") * 10 + F.when(
        F.col("event_id") % 500 >= 250, 0).otherwise(100000)).alias("questions"))
    return metrics.queries_per_second(snap).select(F.coalesce("host", F.lit("host0")).alias("host"), "ts", F.round("qps", 6).alias("qps"))


@query("severity_category_rollup", "select severity, category, count(*) as n, cast(grouping_id(severity, category) as bigint) as level from ev group by rollup(severity, category)")
def _(spark, d):
    return views.severity_category_rollup(events(spark, d)).select("severity", "category", "n", F.col("level").cast("long").alias("level"))


@query("distinct_logs", """select account, string_agg(log_file, '|' order by log_file) as logs from (
  select *, row_number() over (partition by account order by log_file) as rn from (select distinct account, log_file from ev where account is not null)) where rn <= 10 group by account""")
def _(spark, d):
    return inc_ops.distinct_logs(events(spark, d).filter("account is not null"), ["account"]).select(
        "account", F.array_join("logs", "|").alias("logs"))


# -- order and top-k ------------------------------------------------------------------------------------------------

@query("newest_n", f"select {EV} from ev order by ts desc, id desc limit 100")
def _(spark, d):
    return views.newest(events(spark, d), 100).select(*EV_COLS)


@query("page", f"select {EV} from (select * from ev where severity = 'warning' order by ts desc, id desc limit 1500 offset 1000)")
def _(spark, d):
    return views.page(views.filter_events(events(spark, d), severity="warning"), 1500, 1000).select(*EV_COLS)


@query("page_by_hours", f"select {EV} from (select * from ev order by ts desc, id desc limit 150 offset 6500)")
def _(spark, d):
    """A deep page of the events stored by day; the hours that were counted with them say where it lies."""
    path, ev = scratch_dir(spark, "by-day"), events(spark, d)
    lifecycle.write_table(ev, path)
    stored = spark.read.parquet(path)
    hours = cut(views.add_hours(views.hour_counts(ev.filter(F.col("category") == "web")), ev.filter(F.col("category") != "web")))
    return views.page_by_hours(stored, hours, 150, 6500).select(*EV_COLS)


@query("page_after", f"""select {EV} from ev where (ts, id) < (timestamp '2024-01-15 00:00:00', '0') order by ts desc, id desc limit 200""")
def _(spark, d):
    return views.page_after(events(spark, d), "2024-01-15 00:00:00", "0", 200).select(*EV_COLS)


@query("latest_snapshot", "select host, ts, cpu_percent, load_1 from (select *, row_number() over (partition by host order by ts desc) as rn from snap) where rn = 1")
def _(spark, d):
    return metrics.latest_snapshot(derived(spark, d, "snap")).select("host", "ts", "cpu_percent", "load_1")


@query("top_processes", """select host, ts, rn as rank, pid, cpu_percent, substr(cmdline, 1, 200) as cmdline from (
  select *, row_number() over (partition by host, ts order by cpu_percent desc, pid) as rn from procs) where rn <= 10""")
def _(spark, d):
    return metrics.top_processes(derived(spark, d, "procs")).select(
        "host", "ts", F.col("rank").cast("long").alias("rank"), "pid", "cpu_percent", "cmdline")


@query("top_processes_memory", """select host, ts, string_agg(pid, ',' order by rn) as pids from (
  select *, row_number() over (partition by host, ts order by memory_percent desc, pid) as rn from procs) where rn <= 10 group by host, ts""")
def _(spark, d):
    return metrics.process_lists(derived(spark, d, "procs"), "memory_percent").select(
        "host", "ts", F.array_join(F.transform("top_mem", lambda p: p["pid"].cast("string")), ",").alias("pids"))


@query("latest_per_key", """select host, fingerprint, id, ts from (select *, row_number() over (partition by host, fingerprint order by ts desc, id desc) as rn
  from inc where state in ('new','acknowledged','investigating')) where rn = 1""")
def _(spark, d):
    return inc_ops.latest_active(derived(spark, d, "inc")).select("host", "fingerprint", "id", "ts")


@query("top_db_queries", """select host, ts, rn as rank, pid, time, substr(info, 1, 100) as query from (
  select *, row_number() over (partition by host, ts order by time desc, "user", db, info) as rn from dbprocs
  where command <> 'Sleep' and "user" not in ('system user', 'root', 'event_scheduler')) where rn <= 10""")
def _(spark, d):
    return metrics.top_db_queries(derived(spark, d, "dbprocs")).select(
        "host", "ts", F.col("rank").cast("long").alias("rank"), "pid", "time", "query")


@query("services_by_name", "select name, host from probes order by name, host")
def _(spark, d):
    return views.services_by_name(derived(spark, d, "probes")).select("name", "host")


@query("snapshot_list", "select host, ts, cpu_percent from snap where ts >= timestamp '2024-01-20 06:00:00' order by ts desc, host limit 2500")
def _(spark, d):
    return views.snapshot_list(derived(spark, d, "snap"), "2024-01-20 06:00:00", 2500).select("host", "ts", "cpu_percent")


@query("connection_limit", "select host, ts, db_connections from snap where db_connections >= 60")
def _(spark, d):
    return metrics.connection_limit(derived(spark, d, "snap"), DeclaredLimits(db_connections=60)).select("host", "ts", "db_connections")


@query("query_limit", """select host, ts, pid, time from dbprocs
  where command <> 'Sleep' and "user" not in ('system user', 'root', 'event_scheduler') and time > 30""")
def _(spark, d):
    return metrics.query_limit(derived(spark, d, "dbprocs")).select("host", "ts", "pid", "time")


@query("alert_rate", "select host, date_trunc('hour', ts) as hour, count(*) as alerts from al group by all having count(*) >= 4")
def _(spark, d):
    return metrics.alert_rate(derived(spark, d, "al"), DeclaredLimits(alerts_per_hour=4))


# -- set operations -------------------------------------------------------------------------------------------------

@query("union_sources", """with a as (select log_name, 0 as p, count(*) as n from access_lines group by all union all
   select 'apache_access', 1, count(*) from error_lines union all select log_name, 1, count(*) from fw_lines group by all)
 select log_name, arg_max(n, p) as n from a where n > 0 group by log_name""")
def _(spark, d):
    def counted(name, priority, log=None):
        return derived(spark, d, name).groupBy((F.lit(log) if log else F.col("log_name")).alias("log_name")).agg(
            F.count(F.lit(1)).alias("n"), F.lit(priority).alias("p"))
    both = counted("access_lines", 0).unionByName(counted("error_lines", 1, "apache_access")).unionByName(counted("fw_lines", 1))
    return lifecycle.latest_per_key(both, ["log_name"], "p").select("log_name", "n")


@query("insert_ignore", "select id, category from ev where severity = 'warning' and id not in (select id from ev where category = 'web')")
def _(spark, d):
    ev = events(spark, d)
    new = ev.filter("severity = 'warning'")
    return lifecycle.insert_ignore(ev.filter("category = 'web'"), new.unionByName(new)).select("id", "category")
