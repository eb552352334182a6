"""Operator actions, retention, upserts, export and table writes."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.config import Retention
from faultline.functions.times import clock
from faultline.lineage import cut
from faultline.operators.views import filter_incidents, newest
from faultline.schemas import CLOSED_STATES, OPERATOR_STATES

INCIDENT_ACTION = "update_incident_"


def apply_incident_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """State, notes and update time after the last legal ``update_incident_<state>`` action of each incident.

    The update time of an incident is that of the action; details hold the notes as JSON.
    """
    state = F.regexp_replace("action", f"^{INCIDENT_ACTION}", "")
    legal = actions.filter((F.col("target_type") == "incident") & F.col("action").startswith(INCIDENT_ACTION)
                           & state.isin(*OPERATOR_STATES))
    last = legal.groupBy(F.col("target_id").alias("id")).agg(F.max_by(
        F.struct(F.col("ts").alias("at"), state.alias("state"),
                 F.coalesce(F.get_json_object("details", "$.notes"), F.lit("")).alias("notes")),
        F.struct("ts", F.col("id"))).alias("_a"))
    return (incidents.join(last, "id", "left")
            .withColumn("state", F.coalesce(F.col("_a.state"), F.col("state")))
            .withColumn("resolution_notes", F.coalesce(F.col("_a.notes"), F.col("resolution_notes")))
            .withColumn("updated_at", F.coalesce(F.col("_a.at"), F.col("updated_at"))).drop("_a"))


def rejected_actions(actions: DataFrame) -> DataFrame:
    """Incident actions whose target state is not one an operator may set."""
    state = F.regexp_replace("action", f"^{INCIDENT_ACTION}", "")
    return actions.filter((F.col("target_type") == "incident") & F.col("action").startswith(INCIDENT_ACTION)
                          & ~state.isin(*OPERATOR_STATES))


def apply_alert_acks(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Acknowledged flag, by whom and when, from the last acknowledge action of each alert."""
    acks = (actions.filter((F.col("target_type") == "alert") & (F.col("action") == "acknowledge_alert"))
            .groupBy(F.col("target_id").alias("id"))
            .agg(F.max_by(F.struct(F.col("user"), F.col("ts").alias("at")), F.struct("ts", F.col("id"))).alias("_a")))
    return (alerts.join(acks, "id", "left")
            .withColumn("acknowledged", F.col("acknowledged") | F.col("_a").isNotNull())
            .withColumn("acknowledged_by", F.coalesce(F.col("_a.user"), F.col("acknowledged_by")))
            .withColumn("acknowledged_at", F.coalesce(F.col("_a.at"), F.col("acknowledged_at"))).drop("_a"))


def audit_trail(actions: DataFrame, new: DataFrame, n: int = 100) -> DataFrame:
    """The action log with new entries appended, newest first."""
    return newest(actions.unionByName(new), n)


def _kept(table: str, df: DataFrame, days: int | None, closed_only: bool, as_of: Column) -> Column:
    if days is None:
        return F.lit(True)
    young = F.col("ts") >= as_of - F.expr(f"INTERVAL '{days}' DAY")  # the bound is computed on the literal's side, so it is pushed down
    if table == "incidents" and closed_only:
        return young | ~F.col("state").isin(*CLOSED_STATES)
    return young


def retain(table: str, df: DataFrame, as_of: Column, policy: Retention = Retention()) -> DataFrame:
    """Rows of a table that its retention keeps."""
    days = getattr(policy, table, None)
    kept = df.filter(_kept(table, df, days, policy.closed_only, as_of))
    if days is None or "event_date" not in df.columns or table == "incidents" and policy.closed_only:
        return kept
    return kept.filter(F.col("event_date") >= F.to_date(as_of - F.expr(f"INTERVAL '{days}' DAY")))


def purge(spark: SparkSession, path: str, table: str, as_of: datetime, policy: Retention = Retention()) -> dict[str, list[str]]:
    """Delete from a table stored by day (write_table) what its retention does not keep; {"dropped": days, "rewritten": days}.

    Days wholly older than the bound go by their name, unread; only the border day is read and written anew, and later days are not
    touched. Of incidents that go only when closed, older days are read, and those that hold a closed one are written anew.
    """
    days = getattr(policy, table, None)
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    if days is None:
        return done
    bound = as_of - timedelta(days=days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = {s.getPath().getName().removeprefix("event_date="): s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("event_date=")}
    old = sorted(day for day in stored if day < str(bound.date()))
    border = [day for day in stored if day == str(bound.date()) and bound.time() != time()]
    closed_only = table == "incidents" and policy.closed_only
    touched = [*old, *border] if closed_only else border
    if touched:
        rows = spark.read.option("basePath", path).parquet(*[stored[day].toString() for day in touched])
        goes = ~F.coalesce(_kept(table, rows, days, policy.closed_only, clock(as_of)), F.lit(True))
        counts = {str(r["event_date"]): r for r in rows.groupBy("event_date").agg(F.count_if(goes).alias("gone"), F.count(F.lit(1)).alias("n")).collect()}
        empty = [day for day in touched if day in counts and counts[day]["gone"] == counts[day]["n"]]
        partly = [day for day in touched if day in counts and 0 < counts[day]["gone"] < counts[day]["n"]]
        if partly:
            kept = cut(rows.filter(F.col("event_date").cast("string").isin(*partly) & ~goes))  # written apart before the old files go
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
        done["rewritten"] = partly
        old = empty if closed_only else [*old, *empty]
    for day in old:
        files.delete(stored[day], True)
    done["dropped"] = sorted(old)
    return done


def retention_report(tables: dict[str, DataFrame], as_of: Column, policy: Retention = Retention()) -> DataFrame:
    """Per table: rows kept and rows deleted."""
    out = None
    for name, df in tables.items():
        keep = _kept(name, df, getattr(policy, name, None), policy.closed_only, as_of)
        one = df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted")).select(
            F.lit(name).alias("table_name"), "kept", "deleted")
        out = one if out is None else out.unionByName(one)
    return out


def latest_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Newest row per key; later columns of ``order`` break ties."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert_services(current: DataFrame, probes: DataFrame) -> DataFrame:
    """Replace by host and name; a probe wins over the stored row of the same time."""
    both = current.withColumn("_p", F.lit(0)).unionByName(probes.withColumn("_p", F.lit(1)))
    return latest_per_key(both, ["host", "name"], "_p", "last_check").drop("_p")


def insert_ignore(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(current.select(key), key, "left_anti")


def export_rows(incidents: DataFrame, state=None, severity=None, limit: int | None = None) -> DataFrame:
    """All matching incidents, or the ``limit`` newest ones."""
    rows = filter_incidents(incidents, state=state, severity=severity)
    return rows if limit is None else newest(rows, limit)


def flatten(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that every column fits a CSV cell."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in df.schema.fields])


def export_json(incidents: DataFrame, path: str, **filters) -> None:
    export_rows(incidents, **filters).write.mode("overwrite").json(path)


def export_csv(incidents: DataFrame, path: str, **filters) -> None:
    flatten(export_rows(incidents, **filters)).write.mode("overwrite").csv(path, header=True, escape='"')


def write_table(df: DataFrame, path: str, sort_by: tuple[str, ...] = ("source", "ts"), mode: str = "append") -> None:
    """Write a table in day partitions, sorted inside files so that Parquet statistics prune reads.

    The rebalance hint brings a day's rows together but lets adaptive execution split a busy day into tasks of the
    advisory size, so neither many tiny files nor one huge task results.
    """
    dated = df.withColumn("event_date", F.to_date("ts")).hint("rebalance", F.col("event_date"))
    present = [c for c in sort_by if c in df.columns]
    (dated.sortWithinPartitions("event_date", *present)
     .write.mode(mode).partitionBy("event_date").option("compression", "zstd").parquet(path))


def read_evolved(spark, path: str, defaults: dict[str, object], schema=None) -> DataFrame:
    """Read files of several schema versions; columns that older files lack get their default.

    With the current ``schema`` given, no footers are read to find it out; without it, they are all read and merged.
    """
    df = spark.read.option("mergeSchema", "true").parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df
