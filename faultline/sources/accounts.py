"""Account data of the hosting panel from its text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text lines as (value, file_name, line_no); account files are small, one file is one split."""
    return spark.read.option("ignoreMissingFiles", "true").text(paths).select(
        "value", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("line_no"))


def domain_map(lines: DataFrame, drop_wildcard: bool = False) -> DataFrame:
    """``domain: user`` lines to (domain, account, line_no); blank and # lines are skipped."""
    text = F.trim("value")
    parts = F.split(text, ":", 2)
    pairs = lines.filter((text != "") & ~text.startswith("#")).select(
        F.lower(F.trim(F.try_element_at(parts, F.lit(1)))).alias("domain"),
        F.trim(F.try_element_at(parts, F.lit(2))).alias("account"), "line_no")
    kept = pairs.filter((F.col("domain") != "") & (F.col("account") != ""))
    return kept.filter(F.col("account") != "*") if drop_wildcard else kept


def last_wins(pairs: DataFrame) -> DataFrame:
    """One account per domain: that of the last line."""
    return pairs.groupBy("domain").agg(F.max_by("account", "line_no").alias("account"))


def _fields(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    return lines.filter(~F.col("file_name").startswith(".")).select(
        F.col("file_name").alias("username"), "line_no",
        F.split_part(text, F.lit("="), F.lit(1)).alias("name"),
        F.trim(F.regexp_replace(text, r"(?s)^[^=]*=?", "")).alias("value"))


def accounts(lines: DataFrame) -> DataFrame:
    """One row per account file (its name is the user): ip, plan, suspended; the last line of a kind wins."""
    def last(name: str):
        return F.max_by("value", F.when(F.col("name") == name, F.col("line_no")))

    return _fields(lines).groupBy("username").agg(
        last("IP").alias("ip"), last("PLAN").alias("plan"),
        F.coalesce(last("SUSPENDED") == "1", F.lit(False)).alias("suspended"),
        F.count_if((F.col("name") == "DNS") & (F.col("value") != "")).alias("dns_entries"))


def account_dns(lines: DataFrame) -> DataFrame:
    """(domain, account) pairs of the DNS= lines."""
    return (_fields(lines).filter((F.col("name") == "DNS") & (F.col("value") != ""))
            .select(F.lower("value").alias("domain"), F.col("username").alias("account")).distinct())
