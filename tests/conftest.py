import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logfold-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_frame(spark):
    def make(feeds):
        """feeds: {device: [(seq, line), ...]}"""
        rows = [(d, s, v) for d, feed in feeds.items() for s, v in feed]
        return spark.createDataFrame(rows, "device string, seq bigint, value string")

    return make


@pytest.fixture(scope="session")
def logs_frame(spark):
    def make(rows):
        """rows: (device, id, session_id, timestamp, level, tag, pid, tid, message)"""
        from logfold.schema import LOGS

        return spark.createDataFrame(rows, LOGS)

    return make
