"""Folders that all executors reach, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the one that ``spark.checkpoint.dir`` names; delete it when its results are stored.

    Only a local session may lack the setting; it then gets one folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path for files of one run."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and go on from there, so lost executors cost no recomputation and readers take the columns they need."""
    path = scratch_dir(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
