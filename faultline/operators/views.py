"""Read side: filters, pages, counts, summary."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.times import clock
from faultline.schemas import ACTIVE_STATES, SEVERITIES

HOUR = "INTERVAL '1' HOUR"


def _matching(df: DataFrame, equal: dict[str, object | None]) -> DataFrame:
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.filter(F.col(column) == F.lit(value))
    return df


def filter_events(events: DataFrame, source=None, category=None, severity=None, account=None, ip_address=None,
                  domain=None, since=None, until=None) -> DataFrame:
    """Conjunction of the given conditions; since and until are inclusive."""
    out = _matching(events, dict(source=source, category=category, severity=severity, account=account,
                                 ip_address=ip_address, domain=domain))
    if since is not None:
        out = out.filter(F.col("ts") >= clock(since))
    return out if until is None else out.filter(F.col("ts") <= clock(until))


def filter_incidents(incidents: DataFrame, state=None, severity=None, category=None, since=None) -> DataFrame:
    out = _matching(incidents, dict(state=state, severity=severity, category=category))
    return out if since is None else out.filter(F.col("ts") >= clock(since))


def filter_alerts(alerts: DataFrame, severity=None, acknowledged: bool | None = None) -> DataFrame:
    out = _matching(alerts, dict(severity=severity)).filter(~F.col("suppressed"))
    return out if acknowledged is None else out.filter(F.col("acknowledged") == F.lit(acknowledged))


def events_since(events: DataFrame, since, source=None) -> DataFrame:
    return filter_events(events, source=source, since=since).orderBy(F.desc("ts"), F.desc("id"))


def active_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("state").isin(*ACTIVE_STATES))


def by_id(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("id") == F.lit(key))


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of as many rows as asked for, newest first."""
    return df.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def hour_counts(df: DataFrame) -> DataFrame:
    """Rows for each hour: hour, n. Small beside the table; kept with it, counts of new batches are added to it."""
    return df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def add_hours(hours: DataFrame, new: DataFrame) -> DataFrame:
    return hours.unionByName(hour_counts(new)).groupBy("hour").agg(F.sum("n").alias("n"))


def page_by_hours(df: DataFrame, hours: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """``page`` of a table stored by day, from its hour_counts: only the hours that hold the page are read and sorted.

    Rows without a time come last and belong to no hour; a page that reaches them is taken by ``page``.
    """
    upto = F.sum("n").over(Window.orderBy(F.desc("hour")))
    held = (hours.filter("hour is not null").withColumn("upto", upto).filter((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit))
            .agg(F.min("hour").alias("oldest"), F.max("hour").alias("newest"), F.min(F.col("upto") - F.col("n")).alias("before"), F.max("upto").alias("upto")).first())
    if held["upto"] is None or held["upto"] < offset + limit:
        return page(df, limit, offset)
    after = held["newest"] + timedelta(hours=1)
    rows = df.filter((F.col("ts") >= clock(held["oldest"])) & (F.col("ts") < clock(after)))
    if "event_date" in df.columns:
        rows = rows.filter(F.col("event_date").between(clock(held["oldest"]).cast("date"), clock(after).cast("date")))
    return page(rows, limit, offset - held["before"])


def page_after(df: DataFrame, last_ts, last_id, limit: int = 100) -> DataFrame:
    """Page that follows a known last row; deep pages then cost no more than the first."""
    ts = clock(last_ts)
    older = df.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < F.lit(last_id))))
    return page(older, limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


# The preset pages and their sizes.
DOMAIN_PAGES = {"database": (("database", 50),), "backups": (("backup", 50),),
                "security": (("security", 50), ("malware", 20))}


def domain_page(events: DataFrame, name: str) -> DataFrame:
    out = None
    for category, size in DOMAIN_PAGES[name]:
        part = newest(filter_events(events, category=category), size)
        out = part if out is None else out.unionByName(part)
    return out


def count_by_severity(**tables: DataFrame) -> DataFrame:
    """table, severity, n with a zero for each severity that does not occur."""
    out = None
    for name, df in tables.items():
        one = df.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
        rows = one.select(F.lit(name).alias("table_name"), F.inline(F.array(
            *[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])))
        out = rows if out is None else out.unionByName(rows)
    return out


def severity_category_rollup(events: DataFrame) -> DataFrame:
    return events.rollup("severity", "category").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def page_counts(alerts_page: DataFrame) -> DataFrame:
    return alerts_page.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"))


def event_stats(events: DataFrame, as_of: Column) -> DataFrame:
    return events.agg(*[F.count_if(F.col("severity") == s).alias(f"events_{s}") for s in SEVERITIES],
                      F.count_if(F.col("ts") >= as_of - F.expr(HOUR)).alias("events_last_hour"))


def incident_stats(incidents: DataFrame) -> DataFrame:
    return incidents.agg(*[F.count_if(F.col("severity") == s).alias(f"incidents_{s}") for s in SEVERITIES],
                         F.count_if(F.col("state").isin(*ACTIVE_STATES)).alias("active_incidents"))


def alert_stats(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*[F.count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in SEVERITIES],
                      F.count_if((F.col("severity") == "critical") & ~F.col("acknowledged")).alias("unacked_critical"),
                      F.count_if((F.col("severity") == "warning") & ~F.col("acknowledged")).alias("unacked_warning"),
                      F.count_if(~F.col("acknowledged") & ~F.col("suppressed")).alias("unack_alerts"))


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames with different columns side by side, as a union folded by one tiny aggregate (no cross join)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def stats(events: DataFrame, incidents: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """All dashboard counters in one row: one conditional aggregate per table."""
    return one_row(event_stats(events, as_of), incident_stats(incidents), alert_stats(alerts))


def server_health(unacked_only: bool = False) -> Column:
    """Health from the counters of ``stats`` and the newest sample's gauges (null without a sample)."""
    prefix = "unacked_" if unacked_only else "alerts_"
    cpu, mem, disk = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("cpu_percent", "memory_percent", "disk_percent"))
    return (F.when((F.col(f"{prefix}critical") > 0) | (cpu > 95) | (mem > 95) | (disk > 95), "critical")
            .when((F.col(f"{prefix}warning") > 0) | (cpu > 80) | (mem > 85) | (disk > 85), "warning")
            .when(F.col("has_snapshot"), "healthy").otherwise("unknown"))


def latest_gauges(snapshots: DataFrame) -> DataFrame:
    """One row with the gauges of the newest sample overall (nulls when there is none)."""
    row = snapshots.agg(F.max_by(F.struct("host", "ts", "cpu_percent", "memory_percent", "disk_percent", "load_1"),
                                 F.struct("ts", "host")).alias("s"))
    return row.select(F.col("s").isNotNull().alias("has_snapshot"), F.col("s.ts").alias("snapshot_ts"), "s.cpu_percent",
                      "s.memory_percent", "s.disk_percent", "s.load_1")


def summary(events: DataFrame, incidents: DataFrame, alerts: DataFrame, snapshots: DataFrame, services: DataFrame,
            as_of: Column, unacked_only: bool = False) -> DataFrame:
    """The dashboard in one row: counters, newest gauges, services up, five newest incidents, health."""
    recent = newest(incidents.select("ts", "id", "severity", "summary"), 5).agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("ts", "id", "severity", "summary")))).alias("recent_incidents"))
    up = services.agg(F.count(F.lit(1)).alias("services_total"),
                      F.count_if(F.col("health") == "healthy").alias("services_healthy"))
    row = one_row(event_stats(events, as_of), incident_stats(incidents), alert_stats(alerts), latest_gauges(snapshots), up, recent)
    return (row.withColumn("alerts_total", F.col("alerts_info") + F.col("alerts_warning") + F.col("alerts_critical"))
            .withColumn("server_health", server_health(unacked_only)))


def services_by_name(services: DataFrame) -> DataFrame:
    """The service list, by name and host."""
    return services.orderBy("name", "host")


def snapshot_list(snapshots: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Samples from ``since`` on (inclusive), newest first; all of them unless a limit is given."""
    rows = snapshots if since is None else snapshots.filter(F.col("ts") >= clock(since))
    rows = rows.orderBy(F.desc("ts"), "host")
    return rows if limit is None else rows.limit(limit)
