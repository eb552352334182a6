"""Greedy operators against a plain Python model, on every way they may take."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.config import LockoutConfig
from faultline.functions.times import clock
from faultline.operators import dedup
from faultline.operators.sequence import fill_forward, previous_row, trailing_count

START = dt.datetime(2025, 3, 9, 1, 30)  # an hour before a clock change in the session's zone


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema="k string, ts timestamp_ntz, id string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def model_cooldown(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


def model_rate(times, limit, window):
    ok, live = [], []
    for t in sorted(times):
        live = [x for x in live if x > t - window]
        if len(live) < limit:
            live.append(t)
            ok.append(t)
    return ok


def test_cooldown_example(spark):
    rows = [("a", at(s), str(s)) for s in (0, 100, 299, 300, 310, 599, 650)]
    got = dedup.cooldown(frame(spark, rows), ["k"], 300).orderBy("ts").collect()
    assert [(r.id, r.n) for r in got] == [("0", 3), ("300", 3), ("650", 1)]


@pytest.mark.parametrize("max_fold", [10_000, 40])
def test_cooldown_any_way(spark, max_fold):
    """One key holds most rows, without a pause; others are sparse. All ways must agree with the model."""
    rng = random.Random(1)
    times = {"hot": [round(rng.uniform(0, 4000), 3) for _ in range(400)],
             "even": [i * 7.0 for i in range(300)],
             "gaps": [b * 5000 + rng.choice([0, 1, 299.999, 300, 300.001, 450]) for b in range(10) for _ in range(4)],
             "one": [5.0], "same": [9.0] * 6}
    rows = [(k, at(t), f"{k}{i:04d}") for k, ts in times.items() for i, t in enumerate(ts)]
    got = dedup.cooldown(frame(spark, rows), ["k"], 300, max_fold).collect()
    for k, ts in times.items():
        mine = sorted((r.ts, r.n) for r in got if r.k == k)
        want = model_cooldown([at(t) for t in ts], dt.timedelta(seconds=300))
        assert [t for t, _ in mine] == want, k
        assert sum(n for _, n in mine) == len(ts), k
        for i, (t, n) in enumerate(mine):
            end = mine[i + 1][0] if i + 1 < len(mine) else dt.datetime.max
            assert n == sum(t <= at(x) < end for x in ts)


def test_cooldown_resets(spark):
    rows = [("a", at(s), str(s)) for s in (0, 100, 200, 250)] + [("b", at(s), str(s)) for s in (0, 100, 250)]
    resets = spark.createDataFrame([("a", at(90)), (None, at(240))], "k string, reset_ts timestamp_ntz")
    epochs = dedup.with_reset_epoch(frame(spark, rows), resets, "k")
    got = dedup.cooldown(epochs, ["k", "reset_epoch"], 300)
    assert sorted((r.k, r.id) for r in got.collect()) == [("a", "0"), ("a", "100"), ("a", "250"), ("b", "0"), ("b", "250")]
    plain = dedup.cooldown(frame(spark, rows), ["k"], 300)
    assert dedup.active_cooldowns(plain, ["k"], clock(at(300))).count() == 2
    assert dedup.active_cooldowns(plain, ["k"], clock(at(301))).count() == 0


def test_rate_example(spark):
    rows = [("c", at(s), f"{s:03d}") for s in (0, 1, 2, 3, 59, 60, 61, 62, 63, 64, 121)]
    got = dedup.rate_limit(frame(spark, rows), ["k"], 3, 60).orderBy("ts").collect()
    assert [int(r.id) for r in got] == [0, 1, 2, 60, 61, 62, 121]


@pytest.mark.parametrize("max_fold", [10_000, 50])
def test_rate_any_way(spark, max_fold):
    rng = random.Random(3)
    times = {"hot": [round(rng.uniform(0, 900), 2) for _ in range(350)], "sparse": [i * 45.0 for i in range(30)],
             "same": [3.0] * 20, "bursts": [b * 200 + i for b in range(5) for i in range(9)]}
    rows = [(k, at(t), f"{k}{i:04d}") for k, ts in times.items() for i, t in enumerate(ts)]
    got = dedup.rate_limit(frame(spark, rows), ["k"], 4, 60, max_fold).collect()
    for k, ts in times.items():
        assert sorted(r.ts for r in got if r.k == k) == model_rate([at(t) for t in ts], 4, dt.timedelta(seconds=60)), k
    assert len({r.id for r in got}) == len(got)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_saturated_runs(spark, monkeypatch, rounds):
    """One key that never falls below the limit, one that does now and then, one only in part; the serial pass from round 0, 1 or 4 on."""
    monkeypatch.setattr(dedup, "SPECULATIVE", rounds)
    rng = random.Random(7)
    times = {"full": [round(rng.uniform(0, 3000), 1) for _ in range(2500)], "light": [round(rng.uniform(0, 30_000), 2) for _ in range(1500)],
             "mixed": [t for b in range(6) for t in [b * 400 + round(rng.uniform(0, 60 if b % 2 else 390), 2) for _ in range(150)]]}
    rows = [(k, at(t), f"{k}{i:05d}") for k, ts in times.items() for i, t in enumerate(ts)]
    got = dedup.rate_limit(frame(spark, rows), ["k"], 3, 60, 40).collect()
    for k, ts in times.items():
        assert sorted(r.ts for r in got if r.k == k) == model_rate([at(t) for t in ts], 3, dt.timedelta(seconds=60)), k


def test_lockout(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), at(round(rng.uniform(0, 2000))), f"{i:04d}", rng.random() < 0.15) for i in range(300)]
    df = frame(spark, rows, "k string, ts timestamp_ntz, id string, success boolean")
    got = {r.id: r for r in dedup.lockout(df, ["k"], LockoutConfig(5, 300)).collect()}
    assert len(got) == len(rows)
    for k in "xy":
        fails = []
        for _, ts, i, success in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            fails = [] if success else [*fails, ts]
            live = [f for f in fails if f > ts - dt.timedelta(seconds=300)]
            assert (got[i].failed, got[i].remaining, got[i].allowed) == (len(live), max(0, 5 - len(live)), len(live) < 5)


def test_fingerprint(spark):
    import hashlib
    row = spark.range(1).select(
        dedup.fingerprint(F.lit("r1"), F.lit(None).cast("string"), F.lit("10.0.0.1"), F.lit("web")).alias("f"),
        dedup.fingerprint(F.lit("r1"), F.lit("acct"), F.lit("10.0.0.1"), F.lit("web"), F.lit("more")).alias("g")).first()
    assert row.f == hashlib.md5(b"r1::10.0.0.1:web:").hexdigest()
    assert row.g == hashlib.md5(b"r1:acct:10.0.0.1:web:more").hexdigest()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_fill_forward(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, None, f"v{i}"])) for i in range(200)]
    got = {r.n: r.v for r in fill_forward(frame(spark, rows, "k string, n long, v string"), ["k"], "n", "v", block).collect()}
    for k in "ab":
        last = None
        for _, n, v in sorted(r for r in rows if r[0] == k):
            last = v or last
            assert got[n] == last


def test_previous_row_and_trailing(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), at(rng.randrange(0, 40_000) + i / 1000), f"{i:04d}") for i in range(200)]
    df = frame(spark, rows)
    prev = {r.id: r.before for r in previous_row(df, ["k"], "ts", 3600, before="id").collect()}
    near = {r.id: r.trailing for r in trailing_count(df, ["k"], window_s=300).collect()}
    for k in "ab":
        last = None
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for _, ts, i in mine:
            assert prev[i] == last
            assert near[i] == sum(ts - dt.timedelta(seconds=300) <= x[1] <= ts for x in mine)
            last = i
