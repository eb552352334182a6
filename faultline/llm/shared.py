"""Reading tables, written intermediate tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that an Arrow mapper turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver reach")
    folder = tempfile.mkdtemp(prefix="faultline-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared one and read it back.

    Cuts lineage: a lost executor costs the tasks it ran, never the steps before. Unlike ``checkpoint()`` the plan runs
    once and the columns stay prunable. All of an application lies in one folder, to be deleted when its results are stored.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row(docs: DataFrame, name: str = "row_of_table") -> DataFrame:
    """``docs`` with a column that tells its rows apart and is the same whenever they are read.

    For a table read from files: the file and the row's place in it, so nothing is written. Any other DataFrame is written
    out once with numbered rows.
    """
    try:
        placed = docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n")))
        placed.schema  # noqa: B018  resolves it now
        return placed
    except AnalysisException:
        return stored(docs.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("n"))), "numbered")


def only_rows(docs: DataFrame, kept: DataFrame, name: str = "row_of_table") -> DataFrame:
    """The rows of ``docs`` (from ``with_row``) that ``kept`` names, without that column."""
    return docs.join(kept.select(name), name, "left_semi").drop(name)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns only, whatever else the table carries."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def smallest_hashes(rows: DataFrame, label: str, n: int) -> DataFrame:
    """Of each value of ``label`` the ``n`` rows (doc_id and the label) with the smallest hash of their id, each pair once.

    Labels are few; rows and ids may be any number, and one id may stand on many rows. From (approximate) counts of different
    ids it is known below which hash over twice as many ids lie, so few rows are shuffled and none gathers a label's rows.
    """
    top = 1 << 30
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(top))
    below = F.lit(0)
    for r in rows.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("ids")).collect():
        below = F.when(F.col(label) == r[label], min(top, top * (2 * n + 64) // max(1, r["ids"]))).otherwise(below)
    nth = F.row_number().over(Window.partitionBy(label).orderBy("rank", "doc_id"))
    few = rows.select("doc_id", label, rank.alias("rank")).where(F.col("rank") < below).distinct()
    return few.withColumn("nth", nth).where(F.col("nth") <= n).select("doc_id", label)


def joined_by_key(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", support: float = 0.001) -> DataFrame:
    """``rows`` (stored) joined with ``small`` (stored, one row a key), with hot keys on the map side.

    A Misra-Gries summary finds every key on at least ``support`` of the rows; only their rows of ``small``, at most
    1 / support, are broadcast. All other keys meet in an ordinary join, in which no key is hot.
    """
    likely = rows.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).where(F.col(key).isNotNull())
    hot = stored(small.join(F.broadcast(likely), key, "left_semi").coalesce(1), "hot")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(small, key, how))


def one_text_each(docs: DataFrame, chosen: DataFrame, label: str) -> DataFrame:
    """doc_id, ``label`` and a text for each pair of ``chosen`` (of a bounded number, so it is broadcast) whose id ``docs`` holds.

    Of several rows with the id the least text, so that the result has a row for each pair at most, always the same one.
    """
    return texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
