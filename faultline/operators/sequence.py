"""Ordered operations that stay balanced when one key holds a large share of the rows.

Each one cuts a key's rows into bounded blocks (of line numbers or of time), works inside the blocks,
and carries between blocks only one small row per block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.times import cell_of, epoch_us


def _carry(blocks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last known value before each block. ``blocks`` has one row per (key, block)."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, "_block", F.last(value, ignorenulls=True).over(before).alias("_carried"))


def _same(rows: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """Join on ``by`` in which null keys meet like any other; columns that hold none join plainly, which keeps the rows' partitioning."""
    plain = [c for c in by if not rows.schema[c].nullable and not others.schema[c].nullable]
    if len(plain) == len(by):
        return rows.join(others, by)
    renamed = others.select(*[F.col(c).alias(f"_of_{c}") if c in by else F.col(c) for c in others.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return rows.join(renamed, same).drop(*[f"_of_{c}" for c in by])


def _with_carry(rows: DataFrame, keys: list[str], order: Column, value: str) -> DataFrame:
    ends = rows.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias(value))
    return _same(rows, _carry(ends, keys, value), [*keys, "_block"])


def fill_forward(rows: DataFrame, keys: list[str], order: str, value: str, block: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Replace nulls of ``value`` by the last non-null one at or before the row, per key, in ``order`` (a long).

    ``within``: columns that come before ``order``, such as the part of a log in which lines are numbered anew.
    """
    cell = cell_of(F.col(order), block)
    blocked = rows.withColumn("_block", F.struct(*within, cell.alias("cell")) if within else cell)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = _with_carry(blocked, keys, F.col(order), value)
    return (carried.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carried"))
            .drop("_block", "_carried"))


def previous_row(rows: DataFrame, keys: list[str], ts: str, block_s: int, **values: str) -> DataFrame:
    """Adds, per key, the named columns of the previous row in time; ``values`` maps new names to columns.

    Rows of one instant are ordered by these columns, so the result does not depend on how rows arrive.
    """
    blocked = rows.withColumn("_block", cell_of(epoch_us(F.col(ts)), block_s * 1_000_000))
    blocked = blocked.withColumn("_row", F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(n) for n, c in values.items()]))
    inside = Window.partitionBy(*keys, "_block").orderBy("_row")
    carried = _with_carry(blocked, keys, F.col("_row"), "_row")
    out = carried.withColumn("_prev", F.coalesce(F.lag("_row").over(inside), "_carried"))
    return (out.select(*rows.columns, *[F.col(f"_prev.{n}").alias(n) for n in values],
                       F.col("_prev._ts").alias("prev_ts")))


def time_cells(rows: DataFrame, ts: str, width_s: int) -> DataFrame:
    """Copy each row into its time cell and, as context only, into the next one.

    Any look-back of at most ``width_s`` is then answered inside one (key, cell) group. Rows to output have
    ``_own`` set. The copy is what lets a hot key be split over many tasks.
    """
    cell = cell_of(epoch_us(F.col(ts)), width_s * 1_000_000)
    return (rows.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
            .withColumn("_own", F.col("_cell") == cell))


def trailing_count(rows: DataFrame, keys: list[str], ts: str = "ts", window_s: int = 300, name: str = "trailing") -> DataFrame:
    """At each row, how many rows of the same key lie in the last ``window_s`` seconds (both ends included).

    Rows are first counted per key and instant; the moving sum runs over those counts inside time cells.
    """
    counts = rows.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    cells = time_cells(counts, ts, window_s)
    by = ", ".join(f"`{k}`" for k in [*keys, "_cell"])
    summed = F.expr(
        f"sum(_n) over (partition by {by} order by `{ts}` "
        f"range between interval {window_s} seconds preceding and current row)")
    sums = cells.withColumn(name, summed).filter("_own")
    return _same(rows, sums.select(*keys, ts, name), [*keys, ts])
