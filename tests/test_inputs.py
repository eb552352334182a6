"""How the driver's tables are read."""

from pyspark.sql import functions as F

from checks import inputs, streams


def test_a_file_of_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    """More splits than row groups: all rows would come to the one task that has the group's middle."""
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        plain = spark.read.parquet(str(tmp_path / "events.parquet"))
        assert cores <= plain.rdd.getNumPartitions() < 3 * cores
        dealt = inputs.table(spark, str(tmp_path), "events")
        shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) >= cores and max(shares) < 60_000 / cores
        assert dealt.exceptAll(plain).count() == 0 and dealt.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streams_of_correlation_ship_what_it_reads(spark):
    """Every event, and no column that the windows do not count."""
    shipped = streams.counted(spark, "/root/testdata/sf0.001")
    assert set(shipped.columns) == set(streams.COUNTED)
    assert shipped.exceptAll(inputs.events(spark, "/root/testdata/sf0.001").select(*streams.COUNTED)).count() == 0
