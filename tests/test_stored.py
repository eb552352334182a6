"""Tables stored by day: retention that deletes, deep pages, many sources."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from faultline.config import Retention
from faultline.operators import lifecycle, views
from faultline.sources.lines import read_sources

NOW = dt.datetime(2025, 6, 30, 6, 0)


def rows_of(spark, n=400):
    rows = [(f"i{k:04d}", NOW - dt.timedelta(hours=2 * k), "open" if k % 50 == 0 else "resolved", "x") for k in range(n)]
    return spark.createDataFrame(rows, "id string, ts timestamp_ntz, state string, source string").replace("open", "new", "state")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_events_go_by_day(spark, tmp_path):
    path, rows = str(tmp_path / "events"), rows_of(spark)
    lifecycle.write_table(rows, path)
    before = files_of(path)
    done = lifecycle.purge(spark, path, "events", NOW, Retention(events=10))
    assert done["rewritten"] == ["2025-06-20"] and len(done["dropped"]) == 23 and max(done["dropped"]) == "2025-06-19"
    after = files_of(path)
    assert {f for f in after if "2025-06-20" not in f} == {f for f in before if f.split("event_date=")[1][:10] > "2025-06-20"}
    assert all(before[f] == t for f, t in after.items() if f in before)
    kept = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert kept == sorted(r["id"] for r in lifecycle.retain("events", rows, F.lit(str(NOW)).cast("timestamp_ntz"), Retention(events=10)).collect())
    assert lifecycle.purge(spark, path, "events", NOW, Retention(events=10)) == {"dropped": [], "rewritten": []}
    assert lifecycle.purge(spark, path, "events", NOW, Retention(events=None)) == {"dropped": [], "rewritten": []}


@pytest.mark.parametrize("closed_only", [True, False])
def test_open_incidents_stay(spark, tmp_path, closed_only):
    path, rows, policy = str(tmp_path / "incidents"), rows_of(spark), Retention(incidents=10, closed_only=closed_only)
    lifecycle.write_table(rows, path)
    lifecycle.purge(spark, path, "incidents", NOW, policy)
    kept = sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert kept == sorted(r["id"] for r in lifecycle.retain("incidents", rows, F.lit(str(NOW)).cast("timestamp_ntz"), policy).collect())
    files = files_of(path)
    assert lifecycle.purge(spark, path, "incidents", NOW, policy) == {"dropped": [], "rewritten": []} and files_of(path) == files


def test_deep_pages(spark, tmp_path):
    path, rows = str(tmp_path / "pages"), rows_of(spark, 300).unionByName(rows_of(spark, 40).withColumn("id", F.concat("id", F.lit("b"))))
    rows = rows.unionByName(rows.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    lifecycle.write_table(rows, path)
    stored, hours = spark.read.parquet(path), views.hour_counts(rows)
    for limit, offset in ((10, 0), (7, 33), (50, 200), (1, 339), (20, 330), (5, 900)):
        want = [r["id"] for r in views.page(rows, limit, offset).collect()]
        got = views.page_by_hours(stored, hours, limit, offset)
        assert [r["id"] for r in got.collect()] == want, (limit, offset)
    plan = views.page_by_hours(stored, hours, 50, 200)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_many_sources_at_once(spark, tmp_path):
    for k in range(20):
        folder = tmp_path / f"s{k}" / f"host=h{k}" / "log=auth_log"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text("".join(f"line {i} of {k}\n" for i in range(5)))
    (tmp_path / "s7" / "host=h7" / "log=auth_log" / "b.txt.gz").write_bytes(b"no archive")
    paths = [str(tmp_path / f"s{k}") for k in (*range(20), 99)]
    lines, failed = read_sources(spark, paths, at_once=4)
    assert sorted(r["path"] for r in failed.collect()) == sorted([paths[7], paths[20]])
    got = lines.groupBy("host").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.countDistinct("line_no").alias("d")).collect()
    assert {r["host"]: (r["n"], r["last"], r["d"]) for r in got} == {f"h{k}": (5, 5, 5) for k in range(20) if k != 7}
    nothing, all_failed = read_sources(spark, paths[20:])
    assert nothing.count() == 0 and all_failed.count() == 1
