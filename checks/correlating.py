"""Windowed correlation. The driver's events are sparse, so windows are hours or days instead of minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived, events
from checks.registry import query
from faultline.catalog import COUNT_LIMITS, PATTERNS
from faultline.config import CorrelationConfig
from faultline.functions.times import epoch_us
from faultline.lineage import cut
from faultline.operators import correlate
from faultline.operators.sequence import trailing_count

DAY = CorrelationConfig(window_s=86400, slide_s=86400)
SLIDING = CorrelationConfig(window_s=21600, slide_s=3600)


def as_text(map_column: str):
    """A count map as sorted name=n text."""
    pairs = F.transform(F.map_entries(map_column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ",")


def windowed(window_s: int, slide_s: int) -> str:
    """Events repeated for each window they lie in."""
    return (f"(select ev.*, time_bucket(interval {slide_s} seconds, ts) - to_seconds(i * {slide_s}) as win_start "
            f"from ev, range({window_s // slide_s}) r(i))")


CATS = ("resource", "security", "web", "database", "backup", "service", "system", "network", "malware", "auth")


def counts(key: str, window_s: int, slide_s: int) -> str:
    per = ", ".join(f"count(*) filter (category = '{c}') as c_{c}" for c in CATS)
    text = " || ".join(f"case when count(*) filter (category = '{c}') > 0 then '{c}=' || count(*) filter (category = '{c}') || ',' else '' end"
                       for c in sorted(CATS))
    return f"""(select host, {key}, win_start, count(*) as event_count, {per}, rtrim({text}, ',') as categories,
  count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'warning') as warning_count
  from {windowed(window_s, slide_s)} where {key} is not null and {key} <> '' group by host, {key}, win_start)"""


def entity_sql(key: str, kind: str, window_s: int, slide_s: int, out: str) -> str:
    nulls = {"ip": "cast(null as varchar) as ip", "account": "cast(null as varchar) as account",
             "domain": "cast(null as varchar) as domain", "category": "cast(null as varchar) as category"}
    names = ", ".join(f"{key} as {out}" if n == out else v for n, v in nulls.items())
    return f"""select '{kind}' as type, case when c_security >= 5 then 'security_spike' when c_web >= 20 then 'connection_flood' else 'brute_force' end as pattern,
  win_start, host, {names}, event_count, case when c_security >= 5 then least(1.0, c_security / 10.0) when c_web >= 20 then least(1.0, c_web / 50.0) else least(1.0, c_auth / 10.0) end::double as confidence,
  categories, critical_count, warning_count from {counts(key, window_s, slide_s)} where event_count >= 5 and (c_security >= 5 or c_web >= 20 or c_auth >= 5)"""


def account_sql(window_s: int, slide_s: int) -> str:
    active = " + ".join(f"(c_{c} >= 2)::int" for c in CATS)
    return f"""select 'account_correlation' as type, case when c_database >= 5 then 'database_abuse' else 'multi_source_abuse' end as pattern, win_start, host,
  cast(null as varchar) as ip, account, cast(null as varchar) as domain, cast(null as varchar) as category, event_count,
  case when c_database >= 5 then least(1.0, c_database / 10.0) else least(1.0, (critical_count + warning_count) / 10.0) end::double as confidence,
  categories, critical_count, warning_count from {counts("account", window_s, slide_s)}
  where event_count >= 3 and (c_database >= 5 or ({active} >= 2 and critical_count + warning_count >= 3))"""


def category_sql(window_s: int, slide_s: int) -> str:
    return f"""select 'category_spike' as type, category || '_spike' as pattern, win_start, host, cast(null as varchar) as ip, cast(null as varchar) as account,
  cast(null as varchar) as domain, category, event_count, least(1.0, (critical_count * 2 + warning_count) / 20.0)::double as confidence,
  categories, critical_count, warning_count from {counts("category", window_s, slide_s)} where event_count >= 10 and (critical_count >= 3 or warning_count >= 5)"""


def all_sql(window_s: int, slide_s: int) -> str:
    return " union all ".join((entity_sql("ip_address", "ip_correlation", window_s, slide_s, "ip"),
                               account_sql(window_s, slide_s), category_sql(window_s, slide_s)))


def shown(df):
    return df.select("type", "pattern", "win_start", "host", "ip", "account", "domain", "category", "event_count", "confidence",
                     as_text("categories").alias("categories"), "critical_count", "warning_count")


@query("corr_ip", entity_sql("ip_address", "ip_correlation", 86400, 86400, "ip"))
def _(spark, d):
    return shown(correlate.correlate_ip(events(spark, d), DAY))


@query("corr_ip_sliding", entity_sql("ip_address", "ip_correlation", 21600, 3600, "ip"))
def _(spark, d):
    return shown(correlate.correlate_ip(events(spark, d), SLIDING))


@query("corr_account", account_sql(86400, 86400))
def _(spark, d):
    return shown(correlate.correlate_account(events(spark, d), DAY))


@query("corr_category_spike", category_sql(21600, 3600))
def _(spark, d):
    return shown(correlate.correlate_category(events(spark, d), SLIDING))


@query("corr_domain", entity_sql("domain", "domain_correlation", 86400, 86400, "domain"))
def _(spark, d):
    return shown(correlate.correlate_domain(events(spark, d), DAY))


@query("correlate_all", all_sql(86400, 86400))
def _(spark, d):
    return shown(correlate.correlate_all(events(spark, d), DAY))


_EVIDENCE = """with corr as ({corr}), hit as (select c.type, c.pattern, c.win_start, c.host, c.{name} as entity, e.id, e.raw_line,
    row_number() over (partition by c.host, c.{name}, c.win_start order by e.ts, e.id) as rn
    from corr c join {events} e on e.host = c.host and e.{key} = c.{name} and e.win_start = c.win_start)
select type, pattern, win_start, host, entity, string_agg(id, ',' order by rn) as ids,
  string_agg(substr(raw_line, 1, 200), '|' order by rn) filter (rn <= 5) as evidence from hit where rn <= 20 group by all"""


def _evidence_sql(kind: str, name: str, key: str, w: int, s: int) -> str:
    return _EVIDENCE.format(corr={"ip": entity_sql("ip_address", "ip_correlation", w, s, "ip"), "category": category_sql(w, s)}[kind],
                            name=name, key=key, events=windowed(w, s))


def _evidence(spark, d, find, name, cfg):
    ev = events(spark, d)
    out = correlate.with_evidence(cut(find(ev, cfg)), ev, cfg)
    return out.select("type", "pattern", "win_start", "host", F.col(name).alias("entity"),
                      F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("ids"),
                      F.array_join("evidence", "|").alias("evidence"))


@query("corr_evidence", _evidence_sql("ip", "ip", "ip_address", 21600, 3600))
def _(spark, d):
    return _evidence(spark, d, correlate.correlate_ip, "ip", SLIDING)


@query("corr_evidence_hot_key", _evidence_sql("category", "category", "category", 86400, 86400))
def _(spark, d):
    return _evidence(spark, d, correlate.correlate_category, "category", DAY)


@query("corr_patterns", " union all ".join(
    f"""select '{p.pattern}' as pattern, '{p.severity}' as severity, '{p.key}' as key_name, host, {p.key} as entity,
  time_bucket(interval 86400 seconds, ts) as win_start, count(*) as event_count from ev where category in ({", ".join(repr(c) for c in p.categories)})
  and {p.key} is not null and {p.key} <> '' group by host, {p.key}, time_bucket(interval 86400 seconds, ts) having count(*) >= {p.min_events}"""
    for p in PATTERNS))
def _(spark, d):
    return correlate.pattern_counts(events(spark, d), window_s=86400)


@query("threshold_counts", " union all ".join(
    f"""select '{c.limit_id}' as limit_id, host, coalesce({c.key}, '') as entity, time_bucket(interval 86400 seconds, ts) as win_start, count(*) as event_count
  from ev where {c.predicate} {"" if c.key == "host" else f"and coalesce({c.key}, '') <> ''"} group by all having count(*) >= 6""" for c in COUNT_LIMITS))
def _(spark, d):
    return correlate.limit_counts(events(spark, d), window_s=86400, at_least=6)


@query("trailing_count", """select id, count(*) over (partition by host, ip_address order by ts range between interval 3 hours preceding and current row) as trailing from ev""")
def _(spark, d):
    return trailing_count(events(spark, d), ["host", "ip_address"], window_s=10800).select("id", "trailing")


@query("confidence", """select category, host, least(1.0, count(*) / 1000.0)::double as confidence from ev group by all""")
def _(spark, d):
    return events(spark, d).groupBy("category", "host").agg(
        correlate.capped(F.count(F.lit(1)), 1000).alias("confidence"))


def _histogram(column: str, names) -> str:
    return "rtrim(" + " || ".join(
        f"case when count(*) filter ({column} = '{n}') > 0 then '{n}=' || count(*) filter ({column} = '{n}') || ',' else '' end" for n in sorted(names)) + ", ',')"


@query("category_histogram", f"""select host, account, count(*) as event_count, {_histogram("category", CATS)} as categories,
  {_histogram("severity", ("info", "warning", "critical"))} as severities from ev where account <> '' group by host, account""")
def _(spark, d):
    return correlate.category_histogram(events(spark, d), "account").select(
        "host", "account", "event_count", as_text("categories").alias("categories"), as_text("severities").alias("severities"))
