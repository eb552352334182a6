"""Connected components of a graph that fits no single task: alternating large and small stars.

Each round hangs every node below the smallest node it knows, once from the side of the larger neighbours and once from
that of the smaller ones; after a few rounds every component is a star around its smallest node. All steps are aggregations
with partial sums and joins, so a node may have any number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """(a, b): every node with a smaller one in its component, and the smallest. ``links``: columns a > b, any repetition.

    No links give no rows; nodes without links are not named.
    """
    now, state = stored(links.select("a", "b").where("a > b").distinct(), "links"), None
    while True:
        count, mix = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not count or (count, mix) == state:
            return now
        state = (count, mix)
        after = stored(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
