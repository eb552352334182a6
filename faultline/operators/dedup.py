"""Fingerprints, cooldown, rate limit and lockout.

Cooldown and rate limit are greedy: whether a row counts depends on which rows counted before it (key columns must not
be called t, id, n, cell, run or part, the names used on the way). Groups are
first reduced exactly, then folded as arrays while they are small. Larger groups are cut where a gap in time makes
the past irrelevant, and runs without such a gap take a way that never puts a whole run into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.config import LockoutConfig
from faultline.functions.times import cell_of, epoch_us, from_epoch_us
from faultline.lineage import cut
from faultline.operators.sequence import time_cells

US = 1_000_000
MAX_FOLD = 5_000  # rows folded as one array; folding copies the array as it grows
MAX_RATE_FOLD = 50_000  # the same for the rate limit, whose way for longer runs goes slice by slice
MAX_DIRECT = 5_000  # rows of a key up to which it is not even looked at for pauses


def fingerprint(rule_id: Column, account: Column, ip: Column, category: Column, extra: Column | None = None) -> Column:
    """md5 of rule:account:ip:category:extra; a missing part counts as ''."""
    parts = [rule_id, account, ip, category, F.lit("") if extra is None else extra]
    joined: list[Column] = []
    for i, p in enumerate(parts):
        joined += ([F.lit(":")] if i else []) + [F.coalesce(p.cast("string"), F.lit(""))]
    return F.md5(F.concat(*joined))


# -- cooldown ---------------------------------------------------------------------------------------------------

def _fold_cooldown(groups: DataFrame, by: list[str], keys: list[str], gap: int) -> DataFrame:
    """Greedy fold of each group's sorted points: a point at least ``gap`` after the last kept one is kept."""
    folded = groups.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "id", "n"))).alias("_p"))
    point = "struct<t:bigint,id:string,n:bigint>"
    start = F.struct(F.array().cast(f"array<{point}>").alias("done"), F.try_element_at("_p", F.lit(1)).alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        grown = F.struct(cur["t"].alias("t"), cur["id"].alias("id"), (cur["n"] + x["n"]).alias("n"))
        return F.when(
            x["t"] - cur["t"] >= gap,
            F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), x.alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), grown.alias("cur")))

    kept = F.aggregate(
        F.slice("_p", F.lit(2), F.size("_p")), start, step,
        lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return folded.select(*by, F.explode(kept).alias("_k")).select(*keys, "_k.t", "_k.id", "_k.n")


def _runs(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """One row per (key, cell of ``gap`` width): run number, rows in the run, first point of the run.

    Only a pause of at least ``gap`` starts a run, and no pause that long fits inside a cell, so the cells' first
    and last points tell all. There are at most (time span / gap) cells per key, however many rows it has.
    """
    cells = points.groupBy(*keys, "cell").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*keys).orderBy("cell")
    first = F.coalesce(F.col("lo") - F.lag("hi").over(w) >= gap, F.lit(True)).cast("int")
    return (cells.withColumn("first", first).withColumn("run", F.sum("first").over(w))
            .withColumn("run_rows", F.sum("rows").over(Window.partitionBy(*keys, "run")))
            .withColumn("run_start", F.min("lo").over(Window.partitionBy(*keys, "run")))
            .withColumn("later_lo", F.min("lo").over(
                Window.partitionBy(*keys, "run").orderBy("cell").rangeBetween(2, Window.unboundedFollowing))))


def _next_points(points: DataFrame, runs: DataFrame, by: list[str], gap: int) -> DataFrame:
    """For each point the first point of its run at least ``gap`` later (null at the end).

    A probe t + gap falls into the next cell. Inside one (key, cell) group, probes and points are swept backwards
    in time with a running minimum; a probe after the cell's last point takes the first point of a later cell.
    """
    own = points.select(*by, "cell", F.col("t").alias("at"), F.col("t").alias("target"), F.lit(None).cast("long").alias("t"))
    probes = points.select(*by, (F.col("cell") + 1).alias("cell"), (F.col("t") + gap).alias("at"),
                           F.lit(None).cast("long").alias("target"), "t")
    sweep = (Window.partitionBy(*by, "cell").orderBy(F.col("at").desc(), F.col("target").desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, 0))
    hit = (own.unionByName(probes)
           .withColumn("nxt", F.last("target", ignorenulls=True).over(sweep)).filter("t is not null"))
    later = runs.select(*by, (F.col("cell") + 1).alias("cell"), "later_lo")
    return (hit.join(later, [*by, "cell"])
            .select(*by, "t", F.coalesce("nxt", "later_lo").alias("nxt")))


def _chase(hops: DataFrame, starts: DataFrame, by: list[str], steps: int) -> DataFrame:
    """All points on the chain start -> next -> next ..., found by doubling the jump length each round."""
    useful = hops.select(*by, F.col("nxt").alias("t")).filter("t is not null").unionByName(starts).distinct()
    hops = cut(hops.filter("nxt is not null").join(useful, [*by, "t"], "left_semi"))
    kept, reach = starts, 1
    while reach < steps:
        kept = cut(kept.unionByName(
            kept.join(hops, [*by, "t"]).select(*by, F.col("nxt").alias("t"))))
        second = hops.select(*by, F.col("t").alias("nxt"), F.col("nxt").alias("nxt2"))
        hops = cut(hops.join(second, [*by, "nxt"]).select(*by, "t", F.col("nxt2").alias("nxt")))
        reach *= 2
    return kept


def _chain_cooldown(points: DataFrame, runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Cooldown of long runs without any group of run size."""
    by = [*keys, "run"]
    runs = cut(runs.select(*by, "cell", "run_start", "later_lo"))
    points = cut(points.join(runs.select(*by, "cell"), [*keys, "cell"]))
    starts = runs.select(*by, F.col("run_start").alias("t")).distinct()
    longest = runs.groupBy(*by).agg((F.max("cell") - F.min("cell") + 1).alias("c")).agg(F.max("c")).first()[0]
    if longest is None:
        return points.select(*keys, "t", "id", "n").limit(0)
    kept = _chase(_next_points(points, runs, by, gap), starts, by, longest + 1)
    # the kept point that covers a point lies in the same cell or the one before
    marks = kept.withColumn("_hit", F.lit(True))
    flagged = points.join(marks, [*by, "t"], "left")
    spread = flagged.withColumn("home", F.explode(F.when(
        F.col("_hit").isNotNull(), F.array(F.col("cell"), F.col("cell") + 1)).otherwise(F.array("cell"))))
    back = Window.partitionBy(*by, "home").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    covered = spread.withColumn("kept_t", F.last(F.when(F.col("_hit"), F.col("t")), ignorenulls=True).over(back))
    counts = covered.filter(F.col("home") == F.col("cell")).groupBy(*by, F.col("kept_t").alias("t")).agg(F.sum("n").alias("n"))
    ids = flagged.filter("_hit").select(*by, "t", "id")
    return ids.join(counts, [*by, "t"]).select(*keys, "t", "id", "n")


EARLIER = ""  # id of what passed in earlier runs


def _with_earlier(points: DataFrame, last_created: DataFrame, keys: list[str]) -> DataFrame:
    """Points after what passed before: that is the first point of its key, and covers any candidate older than itself."""
    seeds = (last_created.groupBy(*keys).agg(F.max(epoch_us(F.col("ts"))).alias("_seed"))
             .join(points.select(*keys).distinct(), keys, "left_semi"))
    moved = points.join(seeds, keys, "left").withColumn("t", F.greatest("t", "_seed")).drop("_seed")
    first = seeds.select(*keys, F.col("_seed").alias("t"), F.lit(EARLIER).alias("id"), F.lit(0).cast("long").alias("n"))
    return moved.unionByName(first).groupBy(*keys, "t").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def cooldown(candidates: DataFrame, keys: list[str], cooldown_s: int = 300, max_fold: int = MAX_FOLD,
             last_created: DataFrame | None = None) -> DataFrame:
    """Candidates that pass the cooldown of their key: columns keys, ts, id, n.

    The first candidate passes; a later one passes when at least ``cooldown_s`` have gone by since the last that
    passed. ``candidates`` holds keys, ts and id (ties in time: smallest id). ``n`` counts the candidates a passing
    one stands for, itself included.

    ``last_created`` (keys, ts): when a candidate of the key last passed in earlier runs. It comes back as a row with id
    EARLIER, whose ``n`` counts the candidates it covers; so batches one after the other pass what one batch would.
    Keys must not be null.
    """
    gap = cooldown_s * US
    points = (candidates.groupBy(*keys, epoch_us(F.col("ts")).alias("t"))
              .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    if last_created is not None:
        points = _with_earlier(points, last_created, keys)
    points = cut(points.withColumn("cell", cell_of(F.col("t"), gap)))
    largest = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= min(max_fold, MAX_DIRECT):
        kept = _fold_cooldown(points, keys, keys, gap)
    else:
        runs = cut(_runs(points, keys, gap))
        short = points.join(runs.filter(F.col("run_rows") <= max_fold).select(*keys, "cell", "run"), [*keys, "cell"])
        long = runs.filter(F.col("run_rows") > max_fold)
        kept = _fold_cooldown(short, [*keys, "run"], keys, gap).unionByName(
            _chain_cooldown(points, long, keys, gap))
    return kept.select(*keys, from_epoch_us(F.col("t")).alias("ts"), "id", "n")


def with_reset_epoch(candidates: DataFrame, resets: DataFrame, key: str) -> DataFrame:
    """Adds reset_epoch: how many resets of this key, or of all keys (null key), happened at or before the row.

    Use it as one more cooldown key. Resets are operator actions; each key's are joined as one small array.
    """
    one = (resets.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.collect_list("reset_ts").alias("_own")))
    every = resets.filter(F.col(key).isNull()).agg(F.collect_list("reset_ts")).scalar()
    none = F.array().cast("array<timestamp_ntz>")
    seen = F.concat(F.coalesce("_own", none), F.coalesce("_all", none))
    return (candidates.join(one, key, "left").withColumn("_all", every)
            .withColumn("reset_epoch", F.size(F.filter(seen, lambda r: r <= F.col("ts")))).drop("_own", "_all"))


def active_cooldowns(kept: DataFrame, keys: list[str], as_of: Column, cooldown_s: int = 300) -> DataFrame:
    """Keys whose last passing candidate is at most ``cooldown_s`` before ``as_of``."""
    return (kept.filter(F.col("ts") <= as_of).groupBy(*keys).agg(F.max("ts").alias("last_created"))
            .filter(epoch_us(as_of) - epoch_us(F.col("last_created")) <= cooldown_s * US))


# -- rate limit --------------------------------------------------------------------------------------------------

def _accept(times: Column, seed: Column, limit: int, window: int) -> Column:
    """Fold of sorted (t, id): accept while fewer than ``limit`` accepted ones are younger than the window."""
    def step(acc: Column, x: Column) -> Column:
        live = F.filter(acc["live"], lambda y: y > x["t"] - window)
        return F.when(
            F.size(live) < limit,
            F.struct(F.concat(live, F.array(x["t"])).alias("live"), F.concat(acc["ok"], F.array(x)).alias("ok")),
        ).otherwise(F.struct(live.alias("live"), acc["ok"].alias("ok")))

    empty = F.array().cast("array<struct<t:bigint,id:string>>")
    return F.aggregate(times, F.struct(seed.alias("live"), empty.alias("ok")), step)


def _fold_rate(rows: DataFrame, by: list[str], limit: int, window: int) -> DataFrame:
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("_p"))
    seed = F.array().cast("array<bigint>")
    return grouped.select(*by, F.explode(_accept(F.col("_p"), seed, limit, window)["ok"]).alias("_k"))


SPECULATIVE = 4  # rounds in which all blocks that start from a wrong state run again at once


def _serial_states(window: int, limit: int, keys: list[str]):
    """Blocks of a key in order (keys, part, t, assumed, out) to (keys, part, seed): the state each block starts from.

    A block whose assumed state proves right is passed over. In the others one jumps from one accepted row to the next that may be one.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = tuple(row.column(c)[0].as_py() for c in keys)
                if key != now:
                    now, live = key, []
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in keys), row.column("part"), pa.array([live], pa.list_(pa.int64()))], names=[*keys, "part", "seed"])
                if live == row.column("assumed")[0].as_py():
                    live = row.column("out")[0].as_py()
                    continue
                times, at = row.column("t")[0].values.to_numpy(), 0
                while at < len(times):
                    live = [x for x in live if x > times[at] - window]
                    if len(live) < limit:
                        live.append(int(times[at]))
                        at += 1
                    else:
                        at = int(np.searchsorted(times, live[0] + window))
                if len(times):
                    live = [x for x in live if x > times[-1] - window]

    return work


def _replay_rate(rows: DataFrame, keys: list[str], limit: int, window: int, block_rows: int) -> DataFrame:
    """Long runs by speculative replay of blocks.

    Every block runs at once from an empty state and hands on at most ``limit`` timestamps. Then only blocks whose state proved to
    be another one than they started from run again, until there is none; a state is forgotten where for a window fewer rows come
    than the limit allows. A run that stays saturated would need a round for each of its blocks, so after SPECULATIVE rounds the states
    of such runs are found in one pass over their blocks in order, block by block and jumping from accepted row to accepted row.
    At last all blocks run at once from their true states.
    """
    per_cell = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("rows"))
    running = Window.partitionBy(*keys).orderBy("cell")
    parts = per_cell.withColumn("part", F.floor((F.sum("rows").over(running) - F.col("rows")) / F.lit(block_rows)))
    by = [*keys, "part"]
    blocks = cut(rows.join(parts.select(*keys, "cell", "part"), [*keys, "cell"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("_p")))
    empty = F.array().cast("array<bigint>")

    def run(of: DataFrame, seed: Column) -> DataFrame:
        return of.select(*by, seed.alias("assumed"), _accept(F.col("_p"), seed, limit, window)["live"].alias("out"))

    def starts(states: DataFrame) -> DataFrame:
        """Each block's state by what the block before it handed on."""
        before = F.lag("out").over(Window.partitionBy(*keys).orderBy("part"))
        return states.withColumn("seed", F.coalesce(before, empty))

    states, wrong = cut(run(blocks, empty)), None
    for round_ in range(SPECULATIVE + 1):
        known = cut(starts(states))
        wrong = known.filter(F.col("seed") != F.col("assumed")).select(*by, "seed")
        if wrong.isEmpty() or round_ == SPECULATIVE:
            break
        again = run(blocks.join(wrong, by), F.col("seed"))
        states = cut(states.join(wrong.select(*by), by, "left_anti").unionByName(again))
    seeds = known.select(*by, "seed")
    if not wrong.isEmpty():
        late = wrong.select(*keys).distinct()
        in_order = (blocks.select(*by, F.transform("_p", lambda x: x["t"]).alias("t")).join(late, keys, "left_semi")
                    .join(known.select(*by, "assumed", "out"), by).repartition(*keys).sortWithinPartitions(*by))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*by).schema.fields)
        serial = in_order.mapInArrow(_serial_states(window, limit, keys), f"{types}, seed array<bigint>")
        seeds = cut(seeds.join(late, keys, "left_anti").unionByName(serial))
    return blocks.join(seeds, by).select(*keys, F.explode(_accept(F.col("_p"), F.col("seed"), limit, window)["ok"]).alias("_k"))


def rate_limit(rows: DataFrame, keys: list[str], limit: int = 10, window_s: int = 60, max_fold: int = MAX_RATE_FOLD) -> DataFrame:
    """Rows (keys, ts, id) let through: at most ``limit`` accepted ones per key in any trailing window.

    A row exactly ``window_s`` old no longer counts. Ties in time go by id. Of rows that share key and time only the
    first ``limit`` can pass, so the others leave before anything is gathered.
    """
    window = window_s * US
    timed = rows.select(*keys, epoch_us(F.col("ts")).alias("t"), F.col("id"))
    first = Window.partitionBy(*keys, "t").orderBy("id")
    reduced = cut(timed.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= limit).drop("_rn")
                  .withColumn("cell", cell_of(F.col("t"), window)))
    largest = reduced.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= min(max_fold, MAX_DIRECT):
        passed = _fold_rate(reduced, keys, limit, window)
    else:
        runs = cut(_runs(reduced, keys, window).select(*keys, "cell", "run", "run_rows"))
        marked = reduced.join(runs, [*keys, "cell"])
        by = [*keys, "run"]
        passed = _fold_rate(marked.filter(F.col("run_rows") <= max_fold), by, limit, window).unionByName(
            _replay_rate(marked.filter(F.col("run_rows") > max_fold).drop("run_rows"), by, limit, window, max_fold))
    return passed.select(*keys, from_epoch_us(F.col("_k.t")).alias("ts"), F.col("_k.id").alias("id"))


# -- lockout -----------------------------------------------------------------------------------------------------

def lockout(attempts: DataFrame, keys: list[str], cfg: LockoutConfig = LockoutConfig()) -> DataFrame:
    """After each attempt (keys, ts, id, success): failures in the trailing window since the last success,
    attempts that remain, and whether another one is allowed. A success clears the failures before it.

    Ties in time go by id. Only the last window matters, so time cells keep hot keys split.
    """
    cells = time_cells(attempts, "ts", cfg.window_s)
    by = ["_cell", *keys]
    order = Window.partitionBy(*by).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    epochs = cells.withColumn("_epoch", F.sum(F.col("success").cast("int")).over(order))
    # frame: (t - window, t], and within equal times up to this row -- microseconds make the open end exact
    part = ", ".join(f"`{k}`" for k in [*by, "_epoch"])
    upto = Window.partitionBy(*by, "_epoch").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    fails = F.sum((~F.col("success")).cast("long"))
    counted = (
        epochs.withColumn("_t", epoch_us(F.col("ts")))
        .withColumn("_seen", fails.over(upto))
        .withColumn("_old", F.expr(
            f"coalesce(sum(cast(not success as bigint)) over (partition by {part} order by _t "
            f"range between unbounded preceding and {cfg.window_s * US} preceding), 0)"))
        .withColumn("failed", F.col("_seen") - F.col("_old")))
    return (counted.filter("_own")
            .withColumn("remaining", F.greatest(F.lit(0).cast("long"), cfg.attempts - F.col("failed")))
            .withColumn("allowed", F.col("failed") < cfg.attempts)
            .drop("_cell", "_own", "_epoch", "_t", "_seen", "_old"))
