"""Reading lines from files, account files, registry."""

import os

from pyspark.sql import functions as F

from faultline.config import ScanConfig
from faultline.sources import accounts, lines as log_lines


def test_line_numbers_survive_splits(spark, tmp_path):
    """A file cut into many splits gets the same line numbers as a whole one."""
    folder = tmp_path / "host=h1" / "log=syslog"
    os.makedirs(folder)
    texts = [f"line {i} " + "x" * (i % 50) if i % 10 else "" for i in range(5000)]
    (folder / "a.log").write_text("\n".join(texts) + "\n")
    (folder / "b.log").write_bytes(b"bad \xff byte\r\n" + b"y" * 5000 + b"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("10000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = log_lines.read_log_files(spark, [str(tmp_path)]).collect()
        seen.append({(os.path.basename(r.file_path), r.line_no, r.raw_line) for r in rows})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    assert {(n, t) for f, n, t in seen[0] if f == "a.log"} == {(i + 1, t) for i, t in enumerate(texts) if t}
    b = {n: t for f, n, t in seen[0] if f == "b.log"}
    assert b[1] == "bad � byte" and b[2] == "y" * 5000
    assert all(r.host == "h1" and r.log_name == "syslog" for r in rows)


def test_length_limit(spark):
    df = spark.createDataFrame([("abcdef",), ("abc\r",), ("\r",), ("",)], "raw_line string")
    assert [r.raw_line for r in log_lines.scan_lines(df, ScanConfig(4)).collect()] == ["abcd...[truncated]", "abc"]


def test_domain_and_account_files(spark):
    pairs = spark.createDataFrame([
        ("# note", "m", 1), ("", "m", 2), ("Example.COM: alice", "m", 3), ("star.net: *", "m", 4), ("no separator", "m", 5),
        ("example.com:  bob ", "m", 6), (": x", "m", 7)], "value string, file_name string, line_no long")
    assert {(r.domain, r.account) for r in accounts.domain_map(pairs, True).collect()} == {("example.com", "alice"), ("example.com", "bob")}
    assert [tuple(r) for r in accounts.last_wins(accounts.domain_map(pairs, True)).collect()] == [("example.com", "bob")]
    assert accounts.domain_map(pairs).filter("account = '*'").count() == 1
    files = spark.createDataFrame([
        ("DNS=A.com", "alice", 1), ("DNS1=zz", "alice", 2), ("IP=1.1.1.1", "alice", 3), ("IP=2.2.2.2", "alice", 4), ("PLAN=gold=1", "alice", 5),
        ("SUSPENDED=1", "alice", 6), ("IP=3.3.3.3", ".hidden", 1), ("x", "bob", 1)], "value string, file_name string, line_no long")
    rows = {r.username: r for r in accounts.accounts(files).collect()}
    assert set(rows) == {"alice", "bob"}
    assert (rows["alice"].ip, rows["alice"].plan, rows["alice"].suspended) == ("2.2.2.2", "gold=1", True)
    assert (rows["bob"].ip, rows["bob"].suspended) == (None, False)
    assert [tuple(r) for r in accounts.account_dns(files).collect()] == [("a.com", "alice")]


def test_registry(spark):
    every = log_lines.source_registry(spark)
    assert every.count() == 15
    some = log_lines.source_registry(spark, ("csf",))
    assert some.count() == 9 and some.filter(F.col("log_name") == "csf_log").first().parser == "firewall"


def test_bad_sources_are_told_and_left_out(spark, tmp_path):
    """A damaged archive and a missing path are reported; the others are read whole."""
    import gzip

    import pytest

    for host, cut in (("good", None), ("bad", 2000)):
        folder = tmp_path / f"host={host}" / "log=syslog"
        os.makedirs(folder)
        packed = gzip.compress("\n".join(f"line {i} {i * 7919}" for i in range(20_000)).encode())
        (folder / "a.log.gz").write_bytes(packed[:len(packed) - cut] if cut else packed)
    paths = [str(tmp_path / "host=good"), str(tmp_path / "host=bad"), str(tmp_path / "host=gone")]
    lines, failed = log_lines.read_sources(spark, paths)
    assert lines.count() == 20_000 and {r.log_name for r in lines.select("log_name").distinct().collect()} == {"syslog"}
    assert {os.path.basename(r.path) for r in failed.collect()} == {"host=bad", "host=gone"} and all(r.error for r in failed.collect())
    with pytest.raises(Exception):
        log_lines.read_log_files(spark, paths[:2]).count()


def test_parsing_reads_each_log_once(spark, tmp_path):
    """Lines are staged by log name, so every parser's share reads only its own partitions."""
    from faultline.operators.parsers.router import parse_all

    for log in ("syslog", "apache_access"):
        folder = tmp_path / "in" / "host=h" / f"log={log}"
        os.makedirs(folder)
        (folder / "a.log").write_text("x\n")
    plan = parse_all(log_lines.read_log_files(spark, [str(tmp_path / "in")]))._jdf.queryExecution().executedPlan().toString()
    scans = [part.split("\n")[0] for part in plan.split("FileScan parquet ")[1:]]
    staged = [s for s in scans if "raw_line" in s]
    assert staged and all("log_name" in s.split("PartitionFilters: ")[1].split("]")[0] for s in staged)


def test_time_bounds_are_pushed_down(spark, tmp_path):
    from faultline.functions.times import clock
    from faultline.operators import lifecycle, metrics

    rows = spark.createDataFrame([("h", "2024-01-05 00:00:00"), ("h", "2024-01-01 00:00:00")], "host string, ts string").select(
        "host", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.lit(1.0).alias(g) for g in metrics.CHART_GAUGES])
    lifecycle.write_table(rows, str(tmp_path / "t"))
    table, now = spark.read.parquet(str(tmp_path / "t")), clock("2024-01-06 00:00:00")
    for df in (lifecycle.retain("snapshots", table, now, lifecycle.Retention(snapshots=3)), metrics.downsample(table, 24 * 2, now)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "event_date" in plan.split("PartitionFilters: ")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan.split("PushedFilters: ")[1]
    assert lifecycle.retain("alerts", rows, now).count() == 2
