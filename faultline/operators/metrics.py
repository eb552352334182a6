"""Resource samples: threshold events, health classes, down-sampling, top processes and queries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.config import DeclaredLimits, Thresholds
from faultline.functions.text import clip, hosted
from faultline.functions.times import epoch_us
from faultline.operators.sequence import previous_row
from faultline.schemas import EVENTS

# Widest range in hours -> bucket, and the named ranges of the charts.
BUCKETS = ((1, "1 minute"), (24, "5 minutes"), (168, "1 hour"))
WIDEST_BUCKET = "6 hours"
RANGES = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
CHART_GAUGES = ("cpu_percent", "memory_percent", "disk_percent", "load_1", "db_connections")
SYSTEM_DB_USERS = ("system user", "root", "event_scheduler")


def threshold_rows(snapshots: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row per sample and gauge at or over its warning limit: metric, value, severity."""
    def gauge(name: str, column: str, warn: Column, crit: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"),
                        warn.cast("double").alias("warn"), crit.cast("double").alias("crit"))

    cores = F.coalesce(F.col("cpu_count"), F.lit(1))
    gauges = [
        gauge("cpu", "cpu_percent", F.lit(limits.cpu[0]), F.lit(limits.cpu[1])),
        gauge("memory", "memory_percent", F.lit(limits.memory[0]), F.lit(limits.memory[1])),
        gauge("disk", "disk_percent", F.lit(limits.disk[0]), F.lit(limits.disk[1])),
        gauge("load", "load_1", cores * limits.load_per_core[0], cores * limits.load_per_core[1]),
    ]
    if limits.check_inodes:
        gauges.append(gauge("inodes", "disk_inodes_used_percent", F.lit(limits.inodes[0]), F.lit(limits.inodes[1])))
    return (snapshots.select("host", "ts", F.inline(F.array(*gauges)))
            .filter(F.col("value") >= F.col("warn"))
            .withColumn("severity", F.when(F.col("value") >= F.col("crit"), "critical").otherwise("warning")))


def threshold_events(snapshots: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The same as rows of the event table, so they join correlation and rules like any other event."""
    critical = F.col("severity") == "critical"
    shown = F.format_string("%.1f", "value")
    label = {"cpu": ("CPU usage critical: ", "CPU usage high: "), "memory": ("Memory usage critical: ", "Memory usage high: "),
             "disk": ("Disk space critical: ", "Disk space low: "), "load": ("Load average critical: ", "Load average high: "),
             "inodes": ("Inode use critical: ", "Inode use high: ")}
    message = F.lit("")
    for metric, (high, low) in label.items():
        message = F.when(F.col("metric") == metric, F.when(critical, high).otherwise(low)).otherwise(message)
    limit = F.when(critical, F.col("crit")).otherwise(F.col("warn"))
    made = {
        "id": F.sha2(F.concat_ws("|", "host", "metric", F.col("ts").cast("string")), 256),
        "ts": F.col("ts"), "host": F.col("host"), "source": F.lit("system"), "category": F.lit("resource"),
        "severity": F.col("severity"),
        "message": F.concat(message, shown, F.lit(" (threshold: "), F.format_string("%.1f", limit), F.lit(")")),
        "raw_line": F.lit(""), "hostname": F.lit(""), "log_file": F.lit(""), "ts_parsed": F.lit(True),
        "metadata": F.to_json(F.struct("metric", "value")), "event_type": F.lit("resource"),
    }
    rows = threshold_rows(snapshots, limits).select(*[c.alias(n) for n, c in made.items()])
    return rows.selectExpr(*[f"cast({f.name if f.name in made else 'null'} as {f.dataType.simpleString()}) as {f.name}"
                             for f in EVENTS.fields])


def service_health(probes: DataFrame) -> DataFrame:
    """Adds health: not_installed, healthy (running) or down."""
    return probes.withColumn("health", F.when(~F.col("installed"), "not_installed")
                             .when(F.col("running"), "healthy").otherwise("down"))


def usage_band(percent: Column) -> Column:
    return F.when(percent >= 90, "danger").when(percent >= 75, "warning").otherwise("success")


def bar_width(percent: Column) -> Column:
    return F.least(F.lit(100.0), percent)


def bucket_for(hours: int) -> str:
    return next((width for most, width in BUCKETS if hours <= most), WIDEST_BUCKET)


def downsample(snapshots: DataFrame, hours: int | str, as_of: Column, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """Average gauges per bucket over the last ``hours`` (a number or a named range), oldest first."""
    hours = RANGES[hours] if isinstance(hours, str) else hours
    bound = as_of - F.expr(f"INTERVAL '{hours}' HOUR")
    recent = snapshots.filter(F.col("ts") >= bound)
    if "event_date" in snapshots.columns:
        recent = recent.filter(F.col("event_date") >= F.to_date(bound))
    return (recent.groupBy(*keys, F.window("ts", bucket_for(hours)).alias("w"))
            .agg(*[F.avg(g).alias(g) for g in CHART_GAUGES])
            .select(*keys, F.col("w.start").alias("ts"), *CHART_GAUGES).orderBy("ts", *keys))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest sample of each host, by a map-side combinable aggregate rather than a sort."""
    others = [c for c in snapshots.columns if c != "host"]
    return (snapshots.groupBy("host").agg(F.max_by(F.struct(*others), "ts").alias("s")).select("host", "s.*"))


def merge_cycle(system: DataFrame, database: DataFrame, cycle_s: int = 30) -> DataFrame:
    """System samples with the database sample of the same host and cycle; on a shared column the latter wins."""
    def cycle(df: DataFrame) -> DataFrame:
        return df.withColumn("_cycle", F.window("ts", f"{cycle_s} seconds")["start"])

    extra = [c for c in database.columns if c not in ("host", "ts")]
    db = (cycle(database).groupBy("host", "_cycle")
          .agg(F.max_by(F.struct(*extra), "ts").alias("_db")))
    joined = cycle(system).join(db, ["host", "_cycle"], "left")
    kept = [c for c in system.columns if c not in extra]
    return joined.select(*kept, *[
        (F.coalesce(F.col(f"_db.{c}"), F.col(c)) if c in system.columns else F.col(f"_db.{c}")).alias(c) for c in extra])


def top_processes(samples: DataFrame, by: str = "cpu_percent", limit: int = 10) -> DataFrame:
    """Per host and sample time, the ``limit`` busiest processes by cpu or memory."""
    busiest = Window.partitionBy("host", "ts").orderBy(F.desc(by), "pid")
    return (samples.withColumn("rank", F.row_number().over(busiest)).filter(F.col("rank") <= limit)
            .withColumn("memory_percent", F.round("memory_percent", 1)).withColumn("cmdline", clip(F.col("cmdline"), 200)))


def process_lists(samples: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """The same as one array per sample, for the snapshot table."""
    name = "top_cpu" if by == "cpu_percent" else "top_mem"
    item = F.struct("rank", "pid", "name", "user", F.col("cpu_percent").alias("cpu"), F.col("memory_percent").alias("mem"), "cmdline")
    listed = top_processes(samples, by, limit).groupBy("host", "ts").agg(F.sort_array(F.collect_list(item)).alias(name))
    return listed.withColumn(name, F.transform(name, lambda p: p.dropFields("rank")))


def long_running(processes: DataFrame) -> DataFrame:
    """Database threads that run a statement for an ordinary user."""
    return processes.filter((F.col("command") != "Sleep") & ~F.col("user").isin(*SYSTEM_DB_USERS))


def top_db_queries(processes: DataFrame, limit: int = 10) -> DataFrame:
    order = Window.partitionBy("host", "ts").orderBy(F.desc("time"), "user", "db", "info")
    return (long_running(processes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .withColumn("query", clip(F.col("info"), 100)))


def connection_limit(snapshots: DataFrame, limits: DeclaredLimits = DeclaredLimits()) -> DataFrame:
    """Samples with at least the declared number of database connections."""
    return snapshots.filter(F.col("db_connections") >= limits.db_connections)


def query_limit(processes: DataFrame, limits: DeclaredLimits = DeclaredLimits()) -> DataFrame:
    """Statements of ordinary users that run longer than declared."""
    return long_running(processes).filter(F.col("time") > limits.query_s)


def alert_rate(alerts: DataFrame, limits: DeclaredLimits = DeclaredLimits()) -> DataFrame:
    """Hosts and clock hours with at least the declared number of alerts, with that number."""
    return (hosted(alerts).groupBy("host", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count(F.lit(1)).alias("alerts"))
            .filter(F.col("alerts") >= limits.alerts_per_hour))


def slow_flag(processes: DataFrame, seconds: int = 5) -> DataFrame:
    return processes.withColumn("slow", F.col("time") > seconds)


def status_counters(lines: DataFrame, names: tuple[str, ...] = ("Questions", "Threads_connected")) -> DataFrame:
    """``name value`` text lines (host, ts, value) to one row per sample with a column per counter."""
    parts = F.split(F.trim("value"), r"\s+")
    named = lines.select("host", "ts", F.try_element_at(parts, F.lit(1)).alias("name"),
                         F.try_element_at(parts, F.lit(2)).try_cast("long").alias("n"))
    return named.groupBy("host", "ts").pivot("name", list(names)).agg(F.max("n"))


def queries_per_second(samples: DataFrame, counter: str = "questions", block_s: int = 86400) -> DataFrame:
    """Rate of a cumulative counter per host; null at the first sample and where the counter was reset."""
    prev = previous_row(samples, ["host"], "ts", block_s, _before=counter)
    secs = (epoch_us(F.col("ts")) - epoch_us(F.col("prev_ts"))) / F.lit(1_000_000.0)
    grown = F.col(counter) - F.col("_before")
    return prev.withColumn("qps", F.when((grown >= 0) & (secs > 0), grown / secs)).drop("_before", "prev_ts")
