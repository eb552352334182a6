"""Streaming forms, run with availableNow over the derived events stored as several files in time order."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from checks.correlating import DAY, all_sql, as_text, entity_sql
from checks.detecting import LOGIN_INCIDENTS, ONE_DAY, _CAND, _HOST_RATE, _candidates, cooled, login_incidents
from checks.inputs import as_of, derived, events
from checks.reading import SUMMARY, shown_summary
from checks.registry import query
from faultline.catalog import rules_frame
from faultline.config import CorrelationConfig
from faultline.functions.times import epoch_us, from_epoch_us, naive
from faultline.lineage import cut, scratch_dir
from faultline.operators import metrics, views as read_views
from faultline.operators.parsers import database
from faultline.streaming import ingest, inserts, live, rollups, stateful, views
from faultline.streaming.cooldown import start_cooldown

CHUNKS = ("2024-01-11", "2024-01-21", "2999-01-01")


def fed(spark, df: DataFrame, name: str, run, chunk_by: str = "ts") -> None:
    """Ship rows as a log shipper would: one time span after the other lands as files, oldest first, and after each of them
    ``run`` is given the stream of all that is there and goes through what is new, as one micro-batch."""
    path, start = scratch_dir(spark, name), "1970-01-01"
    for end in CHUNKS:
        span = (F.col(chunk_by) >= F.lit(start).cast("timestamp_ntz")) & (F.col(chunk_by) < F.lit(end).cast("timestamp_ntz"))
        df.filter(span).write.mode("append").parquet(path)
        run(spark.readStream.schema(df.schema).parquet(path))
        start = end


def finished(spark, df: DataFrame, make, name: str, mode: str = "append", chunk_by: str = "ts") -> DataFrame:
    """Run the stream that ``make`` builds over all rows, span by span, and read what it wrote."""
    out, state = scratch_dir(spark, name), scratch_dir(spark, name + "-state")

    def run(stream: DataFrame) -> None:
        writer = make(stream).writeStream.option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            query_ = writer.format("parquet").option("path", out).start()
        else:
            query_ = writer.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
        query_.awaitTermination()

    fed(spark, df, name + "-in", run, chunk_by)
    return spark.read.parquet(out)


@query("stream_ingest", """select category, severity, count(*) as n from (
  select case when regexp_matches(lower(raw_line), '(wp-login.php|/.env) http') then 'security' else 'web' end as category,
    case when regexp_matches(lower(raw_line), '(wp-login.php|/.env) http') then 'warning' when regexp_matches(raw_line, '" 503 ') then 'critical' when regexp_matches(raw_line, '" 500 ') then 'warning' else 'info' end as severity
  from access_lines where regexp_matches(raw_line, '" (50\\d|401|403) ')) group by all""")
def _(spark, d):
    """Access lines shipped as text chunks, parsed by the intake stream into the event table."""
    lines = derived(spark, d, "access_lines")
    source, sink = scratch_dir(spark, "shipped"), scratch_dir(spark, "events")
    for host in ("host0", "host1"):
        (lines.filter(F.col("host") == host).select("raw_line").repartition(3).write.mode("append").text(f"{source}/host={host}/log=apache_access"))
    ingest.start_ingest(spark, source, sink, scratch_dir(spark, "ingest-state"), every=None, max_files=2).awaitTermination()
    return spark.read.parquet(sink).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("stream_compact", "select cast(ts as date) as day, count(*) as n, count(distinct id) as ids from ev where ts < timestamp '2024-01-15' group by all")
def _(spark, d):
    """Micro-batches' files of closed days, made into one set of files for each day; running it twice changes nothing."""
    ev = events(spark, d).select("id", "ts", "source")
    intake, table = scratch_dir(spark, "intake"), scratch_dir(spark, "days")
    for batch in range(3):
        ingest.write_batch(ev.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == batch), intake, batch)
    for _ in range(2):
        ingest.compact_days(spark, intake, table, "2024-01-15")
    return spark.read.parquet(table).groupBy(F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


#: What the windows are counted from: a stored stream is read by columns, so only these are shipped.
COUNTED = ("ts", "host", "category", "severity", "ip_address", "account", "domain")


def counted(spark, d) -> DataFrame:
    """Every event, with the columns that correlation reads."""
    return events(spark, d).select(*COUNTED)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("type", "pattern", naive(F.col("win_start")).alias("win_start"), "host", "ip", "account", "domain", "category",
                     "event_count", "confidence", as_text("categories").alias("categories"), "critical_count", "warning_count")


@query("stream_correlate", entity_sql("ip_address", "ip_correlation", 86400, 86400, "ip"))
def _(spark, d):
    return _shown(finished(spark, counted(spark, d), lambda s: views.stream_correlate(s, "ip", DAY), "corr", "complete"))


@query("stream_correlate_category", f"""select * from ({all_sql(86400, 86400)}) where type = 'category_spike'""")
def _(spark, d):
    return _shown(finished(spark, counted(spark, d), lambda s: views.stream_correlate(s, "category", DAY), "corr", "complete"))


@query("stream_correlate_closed", f"""select * from ({all_sql(86400, 86400)}) where type = 'account_correlation'
  and win_start + interval 1 day <= (select max(ts) from ev) - interval 1 day""")
def _(spark, d):
    """Append mode: only windows that the watermark has closed."""
    return _shown(finished(spark, counted(spark, d), lambda s: views.stream_correlate(s, "account", DAY), "corr"))


TENTHS = CorrelationConfig(window_s=86400, slide_s=8640)


@query("stream_correlate_sliding", f"""select * from ({all_sql(86400, 8640)}) where type = 'ip_correlation'
  and win_start + interval 1 day <= (select max(ts) from ev) - interval 1 day""")
def _(spark, d):
    """Windows of ten panes, in two chained stateful steps."""
    return _shown(finished(spark, counted(spark, d), lambda s: views.stream_correlate(s, "ip", TENTHS), "corr"))


@query("late_data", """with s as (select ts, (ts >= timestamp '2024-01-11' and ts < timestamp '2024-01-21') and id like '%7' as held from ev),
  h as (select max(ts) - interval 60 seconds as oldest from s where ts < timestamp '2024-01-21' and not held)
select count(*) as rows_total, count(*) filter (held and ts < oldest) as rows_late from s, h""")
def _(spark, d):
    """Some events of the second span arrive in the third chunk: they go to the late table."""
    ev = events(spark, d).select("id", "ts", "host", "source")
    second = (F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    shipped = ev.withColumn("shipped", F.when(second & F.col("id").endswith("7"), F.lit("2024-01-22").cast("timestamp_ntz")).otherwise(F.col("ts")))
    good, late, state = scratch_dir(spark, "on-time"), scratch_dir(spark, "late"), scratch_dir(spark, "late-state")
    fed(spark, shipped, "shipped", lambda s: ingest.start_late_split(s.drop("shipped"), good, late, state, delay_s=60).awaitTermination(), "shipped")
    n_late = spark.read.schema("id string").parquet(late).agg(F.count(F.lit(1)).alias("rows_late"))
    n_good = spark.read.schema("id string").parquet(good).agg(F.count(F.lit(1)).alias("g"))
    return read_views.one_row(n_good, n_late).select((F.col("g") + F.col("rows_late")).alias("rows_total"), "rows_late")


@query("stream_cooldown", f"with recursive cand as ({_CAND}), {cooled('cand', 43200)} select host, fingerprint, ts, id from kept")
def _(spark, d):
    stateful.use_rocksdb(spark)
    candidates = _candidates(spark, d).withColumn("us", epoch_us(F.col("ts")))
    kept = finished(spark, candidates, lambda s: stateful.stream_cooldown(s.drop("ts"), ["host", "fingerprint"], 43200), "kept")
    return kept.select("host", "fingerprint", from_epoch_us(F.col("us")).alias("ts"), "id")


@query("stream_cooldown_batches", f"with recursive cand as ({_CAND}), {cooled('cand', 43200)} select host, fingerprint, ts, id from kept")
def _(spark, d):
    """The batch operator on each micro-batch, seeded with what passed before; keys whose cooldown is over leave the state."""
    candidates = _candidates(spark, d)
    out, last, state = scratch_dir(spark, "passed"), scratch_dir(spark, "last"), scratch_dir(spark, "cooldown-state")
    fed(spark, candidates, "cand", lambda s: start_cooldown(s, ["host", "fingerprint"], out, last, state, 43200, every=None).awaitTermination())
    return spark.read.parquet(out).select("host", "fingerprint", "ts", "id")


@query("stream_rate_limit", _HOST_RATE + "select host, ts, id from r where ok")
def _(spark, d):
    stateful.use_rocksdb(spark)
    rows = derived(spark, d, "al").select("host", "ts", "id").withColumn("us", epoch_us(F.col("ts")))
    passed = finished(spark, rows, lambda s: stateful.stream_rate_limit(s.drop("ts"), ["host"], 10, 86400), "passed")
    return passed.select("host", from_epoch_us(F.col("us")).alias("ts"), "id")


@query("stream_slow_query", """with p as (select *, nullif(regexp_extract(raw_line, '^# User@Host:\\s+(\\S+?)(?:\\[\\S*\\])?\\s+@', 1), '') as u from slow_lines),
  f as (select *, last_value(u ignore nulls) over (partition by host, file_path order by line_no rows between unbounded preceding and current row) as usr from p)
select host, file_path, line_no, coalesce(usr, 'unknown') as q_user from f where raw_line like '# Query_time:%'""")
def _(spark, d):
    stateful.use_rocksdb(spark)
    lines = derived(spark, d, "slow_lines")
    raw = F.col("raw_line")
    heads = lines.filter(raw.startswith("# ")).select(
        "host", "file_path", "line_no", "arrival_ts", raw.startswith("# Query_time:").alias("is_query"),
        database.slow_user(raw)["u"].alias("q_user"))
    filled = finished(spark, heads, lambda s: stateful.stream_slow_query_user(s.drop("arrival_ts")), "slow", chunk_by="arrival_ts")
    return filled.select("host", "file_path", "line_no", "q_user")


class _Stopped(Exception):
    pass


@query("live_incidents", LOGIN_INCIDENTS)
def _(spark, d):
    """Login, access and slow logs as a live stream in three micro-batches. The second one breaks off between its writes and runs
    again; the incidents of the login log are those of one batch over all lines."""
    root, state, broke = scratch_dir(spark, "live"), scratch_dir(spark, "live-state"), []

    def breaks(step: str) -> None:
        if step == "history" and live.LiveTables(spark, root).committed() == 0 and not broke:
            broke.append(step)
            raise _Stopped(step)

    def run(stream: DataFrame) -> None:
        for _ in range(2):
            try:
                live.start_live(stream, root, state, domains, users, rules, live.LiveConfig(DAY, ONE_DAY, 0), every=None, after=breaks).awaitTermination()
                return
            except StreamingQueryException as stopped:
                if "_Stopped" not in str(stopped):
                    raise

    domains, users, rules = derived(spark, d, "domains"), derived(spark, d, "users"), rules_frame(spark)
    lines = derived(spark, d, "auth_lines").unionByName(derived(spark, d, "access_lines")).unionByName(derived(spark, d, "slow_lines"))
    fed(spark, lines, "lines", run, "arrival_ts")
    return login_incidents(live.LiveTables(spark, root).all_incidents())


@query("stream_summary", "select count(*) filter (severity = 'critical') as events_critical, (select count(*) from inc where state in ('new','acknowledged','investigating')) as active_incidents from ev")
def _(spark, d):
    ev, inc, al = events(spark, d), derived(spark, d, "inc"), derived(spark, d, "al")
    snap, services = derived(spark, d, "snap"), metrics.service_health(derived(spark, d, "probes"))
    now = as_of(ev)
    out, state = scratch_dir(spark, "summary"), scratch_dir(spark, "summary-state")
    fed(spark, ev.select("id", "ts"), "ticks", lambda s: views.start_summary(
        s, lambda: read_views.summary(ev, inc, al, snap, services, now), out, state, every=None).awaitTermination())
    newest = F.max_by(F.struct("events_critical", "active_incidents"), "batch_id").alias("s")
    return spark.read.parquet(out).agg(newest).select("s.*")


@query("stream_rollup", SUMMARY)
def _(spark, d):
    """The summary from counters alone: events as they come in, incidents of which half change their state, alerts, samples."""
    ev, inc, path, state = events(spark, d), derived(spark, d, "inc"), scratch_dir(spark, "rollup"), scratch_dir(spark, "rollup-state")
    fed(spark, ev.select("ts", "severity"), "rollup-in", lambda s: rollups.start_rollup(s, rollups.event_rows, path, state, every=None).awaitTermination())
    moved = inc.filter("k % 2 = 1")
    first = inc.withColumn("state", F.when(F.col("k") % 2 == 1, "new").otherwise(F.col("state")))
    roll = cut(rollups.merged(rollups.newest_rollup(spark, path), rollups.incident_rows(first), rollups.alert_rows(derived(spark, d, "al")),
                              rollups.sample_rows(derived(spark, d, "snap"))))
    roll = rollups.merged(roll, rollups.incident_rows(moved, moved.withColumn("state", F.lit("new"))))
    return shown_summary(rollups.summary_of(roll, metrics.service_health(derived(spark, d, "probes")), as_of(ev)))


@query("stream_dedup_ids", "select id, severity from ev")
def _(spark, d):
    """Each chunk is shipped twice at once; every id is stored once."""
    ev = events(spark, d).select("id", "ts", "severity")
    return finished(spark, ev.unionByName(ev), lambda s: ingest.dedup_ids(s, 86400), "dedup").select("id", "severity")


@query("stream_insert_ignore", "select id, severity, ts from ev")
def _(spark, d):
    """Every event comes again eleven days later, with another time: stored is the first one, whatever lies between."""
    ev = events(spark, d).select("id", "ts", "severity")
    again = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL '11' DAY"))
    path, filters, state = scratch_dir(spark, "stored"), scratch_dir(spark, "filters"), scratch_dir(spark, "insert-state")
    # of two rows of one id in the last span the earlier one is stored, as it is the first to come
    both = ev.unionByName(again.filter(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))).unionByName(
        again.filter((F.col("ts") >= F.lit("2024-01-31").cast("timestamp_ntz")) & (F.col("ts") - F.expr("INTERVAL '11' DAY") < F.lit("2024-01-21").cast("timestamp_ntz"))))
    fed(spark, both, "twice", lambda s: inserts.start_insert(s, path, filters, state, every=None).awaitTermination())
    return spark.read.parquet(path).select("id", "severity", "ts")
