"""Lines of every format: kept or dropped, severity, category, fields, times."""

import datetime as dt

import pytest

from faultline.functions import text
from faultline.operators.parsers import router
from faultline.operators.parsers.base import LineParser, event, parse, raw
from faultline.operators.parsers.security import AUTH_STRICT_USER

ARRIVAL = dt.datetime(2025, 7, 1, 12)

# log, line, expected: None (dropped) or the fields that must hold
CASES = [
    ("apache_access", '203.0.113.5 - - [22/Jun/2025:10:00:01 +0200] "GET /cart HTTP/1.1" 500 17 "-" "agent"',
     dict(severity="warning", category="web", status_code=500, ip_address="203.0.113.5", ts=dt.datetime(2025, 6, 22, 10, 0, 1), size=17)),
    ("apache_access", '203.0.113.5 - bob [22/Jun/2025:10:00:01 +0000] "GET /cart HTTP/1.1" 503 -',
     dict(severity="critical", category="web", status_code=503, size=0)),
    ("apache_access", '203.0.113.5 - - [22/Jun/2025:10:00:01 +0000] "GET /cart HTTP/1.1" 200 17 "-" "agent"', None),
    ("apache_access", '203.0.113.5 - - [22/Jun/2025:10:00:01 +0000] "GET /cart HTTP/1.1" 404 17 "-" "agent"', None),
    ("apache_access", '2001:db8::1 - - [22/Jun/2025:10:00:01 +0000] "POST /Wp-Login.php HTTP/1.1" 403 9 "-" "agent"',
     dict(severity="warning", category="security", ip_address="2001:db8::1",
          message="Suspicious path asked by 2001:db8::1: POST /Wp-Login.php")),
    ("apache_access", '203.0.113.5 - - [22/Jun/2025:10:00:01 +0000] "GET /.env HTTP/1.1" 503 9',
     dict(severity="warning", category="security")),
    ("apache_access", '203.0.113.5 - - [31/Foo/2025:10:00:01 +0000] "GET /a HTTP/1.1" 401 9',
     dict(severity="info", category="web", ts=ARRIVAL, ts_parsed=False)),
    ("apache_access", "# a comment", None),
    ("apache_access", "not a log line", None),
    ("apache_error", "[Sun Jun  2 03:04:05.250000 2024] [proxy:error] [pid 77:tid 9] [client 198.51.100.7:4000] no route to host shop.example.com today",
     dict(severity="warning", ip_address="198.51.100.7", domain="shop.example.com", ts=dt.datetime(2024, 6, 2, 3, 4, 5, 250000))),
    ("apache_error", "[Sun Jun 02 03:04:05 2024] [crit] disk", dict(severity="critical", ip_address="", domain=None, ts=dt.datetime(2024, 6, 2, 3, 4, 5))),
    ("apache_error", "[Sun Mar 09 02:30:00 2025] [notice] in the clock change gap", dict(severity="info", ts=dt.datetime(2025, 3, 9, 2, 30))),
    ("apache_error", "2025-06-22 10:00:00.123 [WARN] [cache] stale entry", dict(severity="warning", message="stale entry", ts=dt.datetime(2025, 6, 22, 10, 0, 0, 123000))),
    ("apache_error", "2025-06-22 10:00:00.123 [odd] text", dict(severity="info")),
    ("mysql_error", "2025-06-22T10:00:00.500000Z 12 [ERROR] [MY-010] Disk quota", dict(severity="warning", category="database", message="Disk quota")),
    ("mysql_error", "2025-06-22T10:00:00Z 12 [Note] ready", dict(severity="info", ts=dt.datetime(2025, 6, 22, 10))),
    ("mysql_error", "2025-06-22T10:00:00.5Z 0 [ERROR] Access denied for user 'ann_app'@'10.0.0.4' (using password: YES) after crash",
     dict(severity="warning", mysql_user="ann_app", message="Access denied to database user 'ann_app' at '10.0.0.4'")),
    ("mysql_error", "2025-06-22 10:00:00 0 [ERROR] Too many connections", dict(severity="critical")),
    ("mysql_error", "990622  9:00:00 [Warning] assertion failed", dict(severity="critical", ts=dt.datetime(1999, 6, 22, 9))),
    ("mysql_error", "no header here", None),
    ("auth_log", "Jun  2 10:00:00 web1 sshd[4321]: Failed password for carol from 198.51.100.9 port 5022 ssh2",
     dict(severity="warning", category="auth", account="carol", ip_address="198.51.100.9", pid=4321, hostname="web1",
          auth_result="failed", ts=dt.datetime(2025, 6, 2, 10))),
    ("auth_log", "Jun 12 10:00:00 web1 sshd[4321]: Accepted password for carol from 198.51.100.9 port 5022 ssh2",
     dict(severity="info", auth_result="success")),
    ("auth_log", "Jun 12 10:00:00 web1 sshd[1]: Failed password for invalid user eve from 198.51.100.9 port 1 ssh2", dict(account="invalid")),
    ("auth_log", "Jun 12 10:00:00 web1 sshd[1]: Received disconnect from 198.51.100.9", None),
    ("csf_log", "Jun 12 10:00:00 web1 lfd[1]: 192.0.2.44 Blocked in firewall", dict(severity="warning", category="security", ip_address="192.0.2.44", ts=ARRIVAL)),
    ("csf_log", "Jun 12 10:00:00 web1 lfd[1]: Brute-Force from 192.0.2.44, Blocked", dict(severity="critical")),
    ("csf_log", "Jun 12 10:00:00 web1 lfd[1]: daemon started", None),
    ("imunify360", "2025-06-22 10:00:00 [CRITICAL] Malware detected in /home/u1/x.php", dict(severity="critical", category="malware", ts=dt.datetime(2025, 6, 22, 10))),
    ("imunify360", "2025-06-22 10:00:00 request denied for 192.0.2.1", dict(severity="warning", category="security", ip_address="192.0.2.1")),
    ("imunify360", "Malware without a date", None),
    ("cpanel_access", "2025-06-22 10:00:00 FAILED user=root ip=192.0.2.8", dict(severity="warning", category="auth", account="root", ip_address="192.0.2.8")),
    ("cpanel_access", "2025-06-22 10:00:00 SUCCESS ip=192.0.2.8", dict(severity="info", account=None, message="Panel login of 'unknown' accepted, address 192.0.2.8")),
    ("cpanel_access", "2025-06-22 10:00:00 PENDING user=root ip=192.0.2.8", None),
    ("cpanel_access", '192.0.2.8 - u [x] "GET /whm HTTP/1.1" 502 10', dict(severity="warning", category="web", status_code=502)),
    ("cpanel_access", '192.0.2.8 - u [x] "GET /whm HTTP/1.1" 399 10', None),
    ("cpanel_error", "[2025-06-22] EMERG license gone", dict(severity="critical", category="system")),
    ("cpanel_error", "[2025-06-22] info fine", None),
    ("backuply", "2025-06-22 10:00:00 Backup of u1 failed", dict(severity="critical", category="backup", event_type="backup_failure")),
    ("backuply", "2025-06-22 10:00:00 completed with 0 errors", dict(event_type="backup_failure")),
    ("backuply", "copy skipped, finished", dict(severity="warning", event_type="backup_warning", ts=ARRIVAL)),
    ("backuply", "2025-06-22T10:00:00 all done", dict(severity="info", event_type="backup_success", ts=ARRIVAL)),
    ("backuply", "tick", None),
    ("syslog", "Jun 12 10:00:00 web1 kernel: Out of memory: Killed process 99 (php)", dict(severity="critical", category="resource", event_type="oom_kill", process="kernel")),
    ("syslog", "Jun 12 10:00:00 web1 app[7]: Warning: odd value", dict(event_type="kernel_panic", pid=7)),
    ("syslog", "[  12.345] php[1]: segfault at 0 ip 0", dict(event_type="segfault", category="system", ts=ARRIVAL)),
    ("syslog", "Jun 12 10:00:00 web1 systemd[1]: Restarting httpd", dict(severity="info", category="service")),
    ("syslog", "Jun 12 10:00:00 web1 cron[1]: job", None),
    ("wptoolkit", "suspicious plugin update", dict(severity="critical", category="security", message="WP Toolkit security: suspicious plugin update")),
    ("wptoolkit", "theme upgrade ok", dict(severity="info", category="system", message="WP Toolkit: theme upgrade ok")),
    ("somewhere_else", "EXT4-fs error on sda1", dict(event_type="disk_error", source="system")),
]


def test_every_format(lines):
    got = {r["log_file"] + r["raw_line"]: r.asDict() for r in router.parse_all(lines([(log, t) for log, t, _ in CASES])).collect()}
    for log, line, want in CASES:
        event_row = got.get(f"/var/log/{log}{line}")
        if want is None:
            assert event_row is None, line
            continue
        assert event_row is not None, line
        assert {k: event_row[k] for k in want} == want, line
    assert len(got) == sum(w is not None for *_, w in CASES)


def test_ids_repeat_on_replay(lines):
    pairs = [(log, t) for log, t, _ in CASES]
    first = {r.id for r in router.parse_all(lines(pairs)).collect()}
    again = {r.id for r in router.parse_all(lines(pairs).repartition(7)).collect()}
    assert first == again and len(first) == sum(w is not None for *_, w in CASES)


def test_slow_query_user_of_each_file(lines, spark):
    def head(user):
        return f"# User@Host: {user}[{user}] @ localhost [192.0.2.{len(user)}]"
    query = "# Query_time: {}  Lock_time: 0.1 Rows_sent: 2  Rows_examined: 30"
    texts = [query.format(5), head("al"), "select 1", query.format(10.5), query.format(31), head("betty"), query.format(10)]
    for block in (1, 2, 100):
        rows = router.slow_queries(lines([("mysql_slow", t) for t in texts]), block).orderBy("query_time").collect()
        assert [(r.query_time, r.mysql_user, r.severity, r.ip_address) for r in rows] == [
            (5.0, "unknown", "info", ""), (10.0, "betty", "info", "192.0.2.5"), (10.5, "al", "warning", "192.0.2.2"),
            (31.0, "al", "critical", "192.0.2.2")]


def test_quality_counts_every_line(lines):
    rows = {r.log_name: r for r in router.parse_quality(lines([(log, t) for log, t, _ in CASES])).collect()}
    for log in {c[0] for c in CASES}:
        want = [w for name, _, w in CASES if name == log]
        assert (rows[log].lines, rows[log].parsed, rows[log].dropped) == (
            len(want), sum(w is not None for w in want), sum(w is None for w in want))


def test_routing_by_source_label(lines):
    """By source label alone a firewall line goes to the login parser, which drops it."""
    pairs = [("csf_log", "Jun 12 10:00:00 web1 lfd[1]: 192.0.2.44 Blocked in firewall")]
    assert router.parse_all(lines(pairs), strict_routing=True).count() == 0
    assert router.parse_all(lines(pairs)).count() == 1


def test_strict_login_name(lines):
    pairs = [("auth_log", "Jun 12 10:00:00 w sshd[1]: Failed password for invalid user eve from 198.51.100.9 port 1 ssh2"),
             ("auth_log", "Jun 12 10:00:00 w su[1]: authentication failure; ruser= rhost=192.0.2.1 user=dora")]
    assert {r.account for r in parse(lines(pairs), AUTH_STRICT_USER).collect()} == {"eve", "dora"}


def test_register_parser(lines, monkeypatch):
    monkeypatch.setattr(router, "PARSERS", dict(router.PARSERS))
    from pyspark.sql import functions as F
    from faultline.catalog import LogSource
    own = LineParser("own", (lambda: {"hit": raw().startswith("X")},),
                     lambda: event(F.col("_hit"), category=F.lit("web"), severity=F.lit("info"), message=raw()))
    router.register_parser("own", own)
    rows = router.parse_all(lines([("own_log", "X1"), ("own_log", "Y")]), [LogSource("own_log", "own", "own", "/x")]).collect()
    assert [r.message for r in rows] == ["X1"]


@pytest.mark.parametrize("shown,want", [
    ("nginx version: 1.25.3", "1.25.3"), ("PHP 8.3.1.2 x", "8.3.1.2"), ("v10.6 built", "10.6"), ("no number\n1x", "no number"), ("", None)])
def test_version(spark, shown, want):
    from pyspark.sql import functions as F
    assert spark.range(1).select(text.version_number(F.lit(shown)).alias("v")).first().v == want


def test_shapes_beyond_the_plain_ones(spark, lines):
    """Escaped quotes, over-long requests, reordered and additional slow-query fields, IPv6, missing pids, null hosts."""
    from pyspark.sql import functions as F

    from faultline.operators.parsers import database, router, security, web
    from faultline.operators.parsers.base import parse

    long_path = "/" + "p" * 20_000
    rows = parse(lines([
        ("apache_access", f'10.0.0.1 - - [22/Jun/2025:10:00:00 +0000] "GET {long_path} HTTP/1.1" 500 12 "-" "a \\"quoted\\" agent"'),
        ("apache_access", '2001:db8::1 - - [22/Jun/2025:10:00:00 +0000] "GET /x HTTP/1.1" 503 -'),
        ("apache_access", '10.0.0.1 - - [22/Jun/2025:10:00:00 +0000] "GET /x" 500 1'),
        ("apache_access", 'host name - - [22/Jun/2025:10:00:00 +0000] "GET /x HTTP/1.1" 500 1')]), web.ACCESS_LOG).collect()
    assert {(r.path, r.ip_address, r.user_agent) for r in rows} == {(long_path, "10.0.0.1", 'a \\"quoted\\" agent'), ("/x", "2001:db8::1", "")}
    slow = lines([("mysql_slow", "# User@Host: app[app] @ web1 [10.0.0.9]  Id: 7"),
                  ("mysql_slow", "# Query_time: 12.5  Rows_examined: 9 Bytes_sent: 4  Lock_time: 0.25 Rows_sent: 3")]).withColumn("host", F.lit(None).cast("string"))
    row = router.slow_queries(slow).first()
    assert (row.query_time, row.lock_time, row.rows_sent, row.rows_examined, row.mysql_user, row.ip_address) == (12.5, 0.25, 3, 9, "app", "10.0.0.9")
    auth = parse(lines([("auth_log", "Jun 22 10:00:00 srv sshd: Failed password for root from 10.0.0.1 port 22 ssh2"),
                        ("auth_log", "Jun 22 10:00:00 srv sshd no colon Failed password for root")]), security.AUTH).collect()
    assert [(r.pid, r.account, r.hostname) for r in auth] == [(None, "root", "srv")]
    assert parse(lines([("mysql_error", "2025-06-22 10:00:00 7 [ERROR] out of words"), ("mysql_error", "12 words [ERROR] x")]), database.ERROR_LOG).count() == 1


def test_owners_are_looked_up_only_for_parsers_that_name_one(spark, lines):
    """No event of the login log has a domain or a database user: nothing is joined for it; the others find what they found."""
    from faultline.operators.enrich import enrich
    from faultline.plans.detect import lines_to_events

    domains = spark.createDataFrame([("shop.com", "acct1")], "domain string, account string")
    users = spark.createDataFrame([("acct2", "acct2")], "mysql_user string, account string")
    raw = lines([("auth_log", "Jul  1 12:00:00 srv sshd[7]: Failed password for u1 from 10.0.0.1 port 22 ssh2"),
                 ("apache_error", "[Mon Jul 01 12:00:00.123456 2024] [core:error] [pid 1:tid 2] [client 10.0.0.2:4711] File missing: Shop.com now"),
                 ("mysql_error", "2024-07-01 12:00:00 9 [ERROR] Access denied for user 'acct2_w'@'localhost' (using password)")])
    logins = lines_to_events(raw, domains, users, registry=[r for r in router.ALL_SOURCES if r.parser == "auth"])
    assert "Join" not in logins._jdf.queryExecution().optimizedPlan().toString()
    got = lines_to_events(raw, domains, users)
    assert sorted(map(str, got.collect())) == sorted(map(str, enrich(router.parse_all(raw), domains, users).select(*got.columns).collect()))
    assert {(r["category"], r["account"]) for r in got.collect()} >= {("web", "acct1"), ("database", "acct2")}
