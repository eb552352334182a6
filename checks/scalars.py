"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import derived, events, table
from checks.registry import query
from faultline.functions import severity, text, times

_TS = "id, host, ts"


@query("ts_access", "select id, date_trunc('second', ts) as t from ev")
def _(spark, d):
    shown = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0530"))
    return events(spark, d).select("id", times.access_ts(times.access_parts(shown)).alias("t"))


@query("ts_error", """select id, case k % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('millisecond', ts) when 2 then ts else null end as t from ev""")
def _(spark, d):
    ev = events(spark, d)
    shown = (F.when(F.col("k") % 4 == 0, F.date_format("ts", "'Sat' MMM d HH:mm:ss yyyy"))
             .when(F.col("k") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
             .when(F.col("k") % 4 == 2, F.date_format("ts", "'Sat'  MMM  d HH:mm:ss.SSSSSS yyyy")).otherwise("24-01-2024 x"))
    return ev.select("id", F.coalesce(times.error_ts(times.error_parts(shown)), times.plain_ts(shown)).alias("t"))


@query("ts_syslog", "select id, date_trunc('second', ts) + interval 366 days as t from ev")
def _(spark, d):
    shown = F.date_format("ts", "MMM d HH:mm:ss")
    now = F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")
    return events(spark, d).select("id", times.syslog_ts(times.syslog_parts(shown), now).alias("t"))


@query("ts_mysql", """select id, case k % 3 when 0 then ts else date_trunc('second', ts) end as t from ev""")
def _(spark, d):
    shown = (F.when(F.col("k") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
             .when(F.col("k") % 3 == 1, F.date_format("ts", "yyMMdd H:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return events(spark, d).select("id", F.coalesce(times.short_ts(times.short_parts(shown)), times.iso_ts(shown)).alias("t"))


@query("ts_plain", "select id, case when k % 10 = 0 then null else date_trunc('second', ts) end as t from ev")
def _(spark, d):
    shown = F.when(F.col("k") % 10 == 0, "2024-13-41 00:00:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events(spark, d).select("id", times.plain_ts(shown).alias("t"))


@query("truncate_text", "select doc_id, md5(substr(text, 1, 300)) as head from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clip(F.col("text"), 300)).alias("head"))


@query("text_match", """select doc_id, contains(lower(text), 'error') or contains(lower(text), 'password') or contains(lower(text), 'license') as any_word,
  starts_with(text, 'The') as starts from documents""")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.contains_any(F.lower("text"), ("error", "password", "license")).alias("any_word"),
                       F.col("text").startswith("The").alias("starts"))


@query("regex_match", "select conv_id, turn, regexp_matches(text, '(?i)fail(ed|ure)?|error|denied') as found from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.has(F.col("text"), "fail(ed|ure)?|error|denied").alias("found"))


@query("extract_ipv4", "select doc_id, nullif(regexp_extract(text, '(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})', 1), '') as ip from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.search(F.col("text"), text.IPV4).alias("ip"))


# values a little off the halves, at which engines may round differently
@query("format_number", """select o_orderkey, printf('%.1f', (o_orderkey * 7 % 100000) / 1000.0 + 0.0123) as one,
  printf('%.2f', (o_orderkey * 7 % 100000) / 1000.0 + 0.0123) as two from orders""")
def _(spark, d):
    value = (F.col("o_orderkey") * 7 % 100000) / 1000 + F.lit(0.0123)
    return table(spark, d, "orders").select("o_orderkey", text.shown_number(value).alias("one"), text.shown_number(value, 2).alias("two"))


@query("json_decode", """select id, case when k % 5 = 0 then '' else 'a' || k || '|b' end as items, case when k % 5 = 1 then null else k::varchar end as v from ev""")
def _(spark, d):
    k = F.col("k")
    broken_list = F.when(k % 5 == 0, "[not json").otherwise(F.concat(F.lit('["a'), k, F.lit('","b"]')))
    broken_map = F.when(k % 5 == 1, "{broken").otherwise(F.concat(F.lit('{"v":'), k, F.lit("}")))
    return events(spark, d).select("id", F.array_join(text.decode_list(broken_list), "|").alias("items"),
                                   F.try_element_at(text.decode_map(broken_map), F.lit("v")).alias("v"))


@query("json_encode", """select id, '{"severity":"' || severity || '"' || case when account is null then '' else ',"account":"' || account || '"' end || ',"k":' || k || '}' as j from ev""")
def _(spark, d):
    return events(spark, d).select("id", text.encode_json(severity=F.col("severity"), account=F.col("account"), k=F.col("k")).alias("j"))


@query("parse_size", "select c_custkey, case when c_custkey % 3 = 0 then 0 else c_custkey end as size from customer")
def _(spark, d):
    shown = F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", text.parse_size(shown).alias("size"))


@query("unit_round", "select l_orderkey, l_linenumber, round(l_quantity / 8, 1) as mb, round(l_quantity / 16, 2) as gb from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.in_unit(F.col("l_quantity"), 8).alias("mb"),
                                              text.in_unit(F.col("l_quantity"), 16, 2).alias("gb"))


@query("first_truthy", "select id, case when account <> '' then account when ip_address <> '' then ip_address else 'unknown' end as who from ev")
def _(spark, d):
    return events(spark, d).select("id", text.first_truthy(F.col("account"), F.col("ip_address"), default="unknown").alias("who"))


@query("severity_map", """select id, case k % 9 when 0 then 'critical' when 1 then 'critical' when 2 then 'critical' when 3 then 'warning' when 4 then 'warning' else 'info' end as web,
  case k % 9 when 3 then 'warning' else 'info' end as db from ev""")
def _(spark, d):
    words = ["emerg", "alert", "crit", "error", "warn", "notice", "info", "debug", "other"]
    level = F.element_at(F.array(*[F.lit(w) for w in words]), F.col("k") % 9 + 1)
    return events(spark, d).select("id", text.lookup(severity.WEB_LEVELS, level, "info").alias("web"),
                                   text.lookup(severity.DB_LEVELS, level, "info").alias("db"))
