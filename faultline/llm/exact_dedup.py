"""Exact duplicates, with frequent texts split off before anything is shuffled by text.

DataFrame operations only. Every row becomes a digest of its normalised text, its length and its id. A Misra-Gries summary
finds the digests that may be frequent; their exact counts and winners (``verified``) are broadcast and settle those rows on
the map side. All other digests go through an ordinary aggregation and join, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import only_rows, stored, with_row

#: A digest on this share of the rows is split off for sure; the summary, and what is broadcast, has 1 / SUPPORT entries at most.
SUPPORT = 0.001
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def winners(rows: DataFrame) -> DataFrame:
    """Of each digest its number of rows, and the row that stays: longest text, then smallest id, then first row."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return (rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
            .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))


def _settled(rows: DataFrame, support: float) -> DataFrame:
    """``rows`` (doc_id, row, n_chars, digest; stored) with group_size, keep_id and keep_row of their digest."""
    likely = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    verified = stored(winners(rows.join(F.broadcast(likely), "digest", "left_semi")).where("group_size > 1").coalesce(1), "frequent")
    frequent = rows.join(F.broadcast(verified), "digest")
    others = rows.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    # rows of equal texts and one file are far larger than their compressed Parquet, by which Spark would broadcast them
    return frequent.unionByName(others.join(winners(others).hint("merge"), "digest"))


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    length = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    return stored(docs.select("doc_id", row.alias("row"), length.alias("n_chars"), digest(F.col("text")).alias("digest")), "digests")


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``, dropped ones too.

    Texts are equal if they are identical without white space. A null text counts as empty; all empty texts are one group.
    Of rows with the same id and text one stays (kept says which, by their order in the table). A null id loses against
    any other. An empty table gives no rows.
    """
    settled = _settled(_rows(docs, F.monotonically_increasing_id()), support)
    return settled.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of equal texts, chosen as in ``exact_duplicates``."""
    placed = with_row(docs)
    settled = _settled(_rows(placed, F.col("row_of_table")), support)
    return only_rows(placed, settled.where(F.col("row") == F.col("keep_row")).withColumnRenamed("row", "row_of_table"))
