"""Correlation limits, rules, incidents and alerts with the default five-minute window."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.catalog import PATTERNS, RULES, rules_frame, scan_rules
from faultline.config import CorrelationConfig, IncidentConfig, NotifyConfig, Thresholds
from faultline.functions.text import render
from faultline.operators import alerts, correlate, incidents, metrics, rules as rule_ops
from faultline.plans import detect
from faultline.schemas import EVENTS, INCIDENT_STATES

START = dt.datetime(2025, 3, 9, 2, 0)


@pytest.fixture
def events(spark):
    """Events from dicts; ``at`` is seconds after START."""
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = dict(dict(id=f"e{i:04d}", host="h1", category="web", severity="info", message="m", metadata="{}",
                          raw_line=f"raw {i}", log_file="/l", source="web"), **r)
            r["ts"] = START + dt.timedelta(seconds=r.pop("at", i))
            full.append(tuple(r.get(f.name) for f in EVENTS.fields))
        return spark.createDataFrame(full, EVENTS)
    return make


def burst(n, **fields):
    return [dict(at=i, **fields) for i in range(n)]


def patterns(df):
    """Patterns with the event count and confidence of their fullest window."""
    rows = df.groupBy("pattern").agg(F.max("event_count").alias("n"), F.max("confidence").alias("c")).collect()
    return {r.pattern: (r.n, r.c) for r in rows}


@pytest.mark.parametrize("category,least,full,name", [
    ("auth", 5, 10, "brute_force"), ("web", 20, 50, "connection_flood"), ("security", 5, 10, "security_spike")])
def test_address_limits(events, category, least, full, name):
    few = events(burst(least - 1, ip_address="1.1.1.1", category=category))
    assert patterns(correlate.correlate_ip(few)) == {}
    enough = events(burst(least, ip_address="1.1.1.1", category=category))
    assert patterns(correlate.correlate_ip(enough)) == {name: (least, least / full)}
    apart = events([dict(at=i * 100, ip_address="1.1.1.1", category=category) for i in range(least)])
    assert patterns(correlate.correlate_ip(apart)) == {}


def test_address_precedence_and_windows(events):
    mixed = events(burst(20, ip_address="1.1.1.1", category="web") + burst(5, ip_address="1.1.1.1", category="auth")
                   + burst(5, ip_address="1.1.1.1", category="security") + burst(50, ip_address="", category="web"))
    found = correlate.correlate_ip(mixed)
    assert patterns(found)["security_spike"] == (30, 0.5)
    # a burst inside one 30 s pane lies in ten windows of 300 s, each seen with all its events
    assert found.count() == 10 and {r.event_count for r in found.collect()} == {30}
    assert found.first().categories == {"web": 20, "auth": 5, "security": 5}


def test_account_and_category_limits(events):
    two_areas = [dict(account="a", category="web", severity="warning")] * 2 + [dict(account="a", category="auth", severity="critical")] * 2
    assert patterns(correlate.correlate_account(events(two_areas))) == {"multi_source_abuse": (4, 0.4)}
    assert patterns(correlate.correlate_account(events(two_areas[:3]))) == {}
    assert patterns(correlate.correlate_account(events(two_areas + burst(5, account="a", category="database")))) == {"database_abuse": (9, 0.5)}
    assert patterns(correlate.correlate_category(events(burst(9, severity="critical")))) == {}
    spike = events(burst(3, severity="critical") + burst(7))
    assert patterns(correlate.correlate_category(spike)) == {"web_spike": (10, 0.3)}
    assert patterns(correlate.correlate_category(events(burst(2, severity="critical") + burst(4, severity="warning") + burst(7)))) == {}


def test_hosts_stay_apart(events):
    rows = burst(4, ip_address="1.1.1.1", category="auth") + burst(4, ip_address="1.1.1.1", category="auth", host="h2")
    assert correlate.correlate_ip(events(rows)).count() == 0


def test_evidence_is_bounded(events):
    cfg = CorrelationConfig()
    df = events([dict(at=i / 10, ip_address="1.1.1.1", category="auth", raw_line="x" * 500) for i in range(100)])
    row = correlate.with_evidence(correlate.correlate_ip(df, cfg), df, cfg).first()
    assert [e.id for e in row.events] == [f"e{i:04d}" for i in range(20)]
    assert len(row.evidence) == 5 and {len(t) for t in row.evidence} == {200}


def test_catalogue_patterns(events):
    rows = burst(2, category="backup") + burst(3, category="resource", account="a") + burst(4, category="malware", ip_address="1.1.1.1")
    got = {(r.pattern, r.entity) for r in correlate.pattern_counts(events(rows)).collect()}
    assert got == {("backup_failure", "h1"), ("resource_abuse", "a"), ("multi_source_abuse", "a")}
    assert len(PATTERNS) == 7


def test_count_limits(events):
    hits = correlate.limit_counts(events(burst(20, event_type="csf_block", category="security")))
    assert [(r.limit_id, r.event_count) for r in hits.collect()] == [("firewall_blocks", 20)]
    assert correlate.limit_counts(events(burst(19, event_type="csf_block", category="security"))).count() == 0


def test_rule_catalogue(spark):
    assert len({r.rule_id for r in RULES}) == 15
    assert scan_rules(spark, "oom_kill").count() == 1 and scan_rules(spark, "nothing").count() == 0
    for rule in RULES:
        assert rule.keywords and rule.categories and rule.remediation and 0 < rule.base_confidence <= 1
    assert len(INCIDENT_STATES) == 6


def test_rule_matching(events, spark):
    df = events([
        dict(severity="warning", message="HTTP 500 error: GET /x"), dict(severity="info", message="HTTP 500"),
        dict(severity="warning", message="fine", metadata='{"size":1503}'), dict(severity="warning", message="fine", category="database", metadata='{"query_time":3}'),
        dict(severity="warning", category="database", message="Too many connections"), dict(severity="critical", category="database", message="Too many connections"),
        dict(severity="critical", category="odd", message="whatever")])
    got = sorted((r.id, r.rule_id) for r in rule_ops.match_rules(df, rules_frame(spark)).collect())
    assert got == [("e0000", "http_500_spike"), ("e0002", "http_503_spike"), ("e0003", "slow_query_spike"), ("e0005", "mysql_connection_limit")]
    fields = "rule_id string, categories array<string>, enabled boolean, min_severity string"
    free = spark.createDataFrame([("high_cpu", [], True, "critical")], fields)
    loose = rule_ops.with_overrides(scan_rules(spark, "high_cpu").withColumn("keywords", F.array().cast("array<string>")), free)
    assert sorted(r.id for r in rule_ops.match_rules(df, loose).collect()) == ["e0005", "e0006"]
    one = rule_ops.with_overrides(scan_rules(spark, "high_cpu").withColumn("keywords", F.array().cast("array<string>")),
                                  spark.createDataFrame([("high_cpu", ["odd"], True, "info")], fields))
    assert sorted(r.id for r in rule_ops.match_rules(df, one).collect()) == ["e0006"]


def test_render_never_fills_twice(spark):
    got = spark.range(1).select(render(F.lit("{a} and {b} and {c}"), {"a": F.lit("{b}"), "b": F.lit("x"), "c": F.lit(None).cast("string")}).alias("t")).first().t
    assert got == "{b} and x and N/A"


def test_incidents_and_alerts_end_to_end(events, spark):
    rows = [dict(at=i * 100, severity="warning", message="HTTP 500 error: GET /x", ip_address="1.1.1.1", account="acme", domain="acme.com") for i in range(7)]
    rows += burst(6, category="auth", ip_address="2.2.2.2", message="Failed login attempt", severity="warning")
    found = {r.rule_id: r for r in detect.detect_incidents(events(rows), rules_frame(spark)).collect()}
    assert set(found) == {"http_500_spike", "brute_force_login", "corr_brute_force"}
    web = found["http_500_spike"]
    # kept at 0, 300 and 600 s; the rest fell into the cooldown
    assert (web.occurrence_count, web.suppressed_count, web.summary) == (3, 4, "Server errors (500) on acme.com")
    assert (web.first_ts, web.last_ts) == (START, START + dt.timedelta(seconds=600))
    login = found["corr_brute_force"]
    assert login.severity == "critical" and login.affected_ip == "2.2.2.2" and len(login.event_ids) == 6
    again = detect.detect_incidents(events(rows), rules_frame(spark))
    assert {r.id for r in again.collect()} == {r.id for r in found.values()}
    made = alerts.to_alerts(again)
    assert {r.affected_entity for r in made.collect()} == {"acme", "2.2.2.2"}
    sent = alerts.deliveries(made, NotifyConfig(channels=("dashboard", "webhook"), rate_limit=1))
    # two alerts at START and one at the end of the first window, 30 s later: one passes per channel
    assert sorted((r.channel, r.status) for r in sent.collect()) == [
        ("dashboard", "limited"), ("dashboard", "limited"), ("dashboard", "sent"), ("webhook", "limited"), ("webhook", "limited"), ("webhook", "sent")]
    assert '"timestamp":"2025-03-09T' in alerts.webhook_payload(made).first().payload


def test_repeat_adds_to_open_incident(events, spark):
    first = detect.detect_incidents(events([dict(severity="warning", message="HTTP 500")]), rules_frame(spark))
    later = [dict(at=1000 + 400 * i, severity="warning", message="HTTP 500", id=f"n{i}") for i in range(3)]
    grown = detect.detect_incidents(events(later), rules_frame(spark), first).collect()
    assert [(r.occurrence_count, r.state) for r in grown] == [(4, "new")]
    closed = first.withColumn("state", F.lit("resolved"))
    both = sorted((r.occurrence_count, r.state) for r in detect.detect_incidents(events(later), rules_frame(spark), closed).collect())
    assert both == [(1, "resolved"), (3, "new")]


def test_thresholds(spark):
    def sample(**g):
        base = dict(host="h", ts=START, cpu_percent=0.0, memory_percent=0.0, disk_percent=0.0, load_1=0.0, cpu_count=4, disk_inodes_used_percent=99.0)
        return tuple({**base, **g}.values())
    schema = "host string, ts timestamp_ntz, cpu_percent double, memory_percent double, disk_percent double, load_1 double, cpu_count int, disk_inodes_used_percent double"
    df = spark.createDataFrame([
        sample(cpu_percent=79.9), sample(cpu_percent=80.0), sample(cpu_percent=95.0), sample(memory_percent=84.99), sample(memory_percent=85.0),
        sample(disk_percent=94.9), sample(disk_percent=95.0), sample(load_1=7.9), sample(load_1=8.0), sample(load_1=16.0)], schema)
    got = sorted((r.metric, r.value, r.severity) for r in metrics.threshold_rows(df).collect())
    assert got == [("cpu", 80.0, "warning"), ("cpu", 95.0, "critical"), ("disk", 94.9, "warning"), ("disk", 95.0, "critical"),
                   ("load", 8.0, "warning"), ("load", 16.0, "critical"), ("memory", 85.0, "warning")]
    assert metrics.threshold_rows(df, Thresholds(check_inodes=True)).filter("metric = 'inodes'").count() == 10
    rules = {r.rule_id for r in detect.resource_incidents(df, rules_frame(spark), inc=IncidentConfig(cooldown_s=1)).collect()}
    assert rules == {"high_cpu", "high_memory", "disk_space_warning"}  # no rule speaks of load


def test_chart_buckets():
    assert [metrics.bucket_for(h) for h in (1, 2, 24, 25, 168, 169, 720)] == [
        "1 minute", "5 minutes", "5 minutes", "1 hour", "1 hour", "6 hours", "6 hours"]


def test_large_catalogues_by_keyword(spark, events):
    """5,000 rules and one hot category: the index of keywords finds what testing rule by rule finds, and the plan joins nothing by category alone."""
    import random

    rng = random.Random(1)
    stems = ["err", "error", "error 5", "error 50", "out of mem", "disk (full)", "a.b*c", "$x^", "[tag]", "müll", "mem", "\\path", "a|b"]
    words = stems + [f"{rng.choice(stems)} {rng.randrange(900)}" for _ in range(4000)] + [f"w{k}" for k in range(2000)]
    kinds = ["web", "database", "odd one"]
    rows = []
    for k in range(5000):
        own = rng.sample(words, rng.randrange(1, 4)) if k % 100 else rng.choice([[], None, [""], ["err", None]])
        rows.append((f"r{k}", f"n{k}", 0.5, f"s{k}", f"x{k}", f"m{k}", rng.choice([["web"], ["database", "odd one"], [], None]), own, rng.choice(["info", "warning", "critical", None]), k % 7 != 0))
    rules = spark.createDataFrame(rows, "rule_id string, name string, base_confidence double, summary string, explanation string, remediation string, "
                                        "categories array<string>, keywords array<string>, min_severity string, enabled boolean")
    said = [" ".join(rng.choices(words, k=4)) for _ in range(60)] + ["", "ERROR 503 Out of Memory", "nothing here"]
    hot = events([dict(message=m, category="web" if i % 3 else rng.choice(kinds), severity=("warning", "critical")[i % 2]) for i, m in enumerate(said)])
    want = sorted((r.id, r.rule_id) for r in rule_ops.match_rules(hot, rules, indexed_from=10_000).select("id", "rule_id").collect())
    assert len(want) > 1000
    for limits in ({}, {"max_index": 10}, {"max_index": 10, "max_rules": 10}):
        matched = rule_ops.match_rules(hot, rules, **limits)
        assert sorted((r.id, r.rule_id) for r in matched.select("id", "rule_id").collect()) == want, limits
        assert set(matched.columns) == set(rule_ops.match_rules(hot, rules, indexed_from=10_000).columns)
    assert len(rule_ops.keyword_patterns(words, chars=5000)) > 3


def test_alternation_finds_all_keywords():
    import re

    words = ["a", "ab", "abc", "bc", "b.c", "c|", "(x", "é", "éa", "z z"]
    (pattern,) = rule_ops.keyword_patterns(words)
    text = "xabc b.c| (x éa zz z"
    found = {m.group(1) for m in re.finditer(pattern, text)}
    closed = {w for f in found for w in words if f.startswith(w)}
    assert closed == {w for w in words if w in text}
