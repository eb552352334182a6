import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    """A session in a zone with clock changes: no result may depend on the session's zone."""
    session = (SparkSession.builder.master("local[4]").appName("faultline-tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.session.timeZone", "America/New_York").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """raw_lines from (log_name, text) pairs, numbered in the order given."""
    from pyspark.sql import functions as F

    def make(pairs, host="h1"):
        rows = [(host, log, f"/var/log/{log}", i, text) for i, (log, text) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "host string, log_name string, file_path string, line_no long, raw_line string")
        return df.withColumn("arrival_ts", F.lit("2025-07-01 12:00:00").cast("timestamp_ntz"))
    return make
