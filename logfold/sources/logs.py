"""Stored log records: Parquet by device, ordered by id inside files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.schema import LOGS

PARTITIONS = ["device"]
# Records of a device that share a task when written: about a million.
BLOCK_BITS = 20


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write records; a large device is cut into blocks of ids, so no task holds all of it.

    Blocks come from the ids themselves, so nothing is sampled beforehand.
    Sessions grow with ids, so sorted files keep the statistics of both narrow:
    a session, a context window and a retention cut each touch few row groups.
    Sessions are not folders, since most are small and a device has many.
    """
    if "continues" in logs.columns:
        # A continued piece would become a second record with the same key.
        whole = F.when(F.col("continues"), F.raise_error(F.lit("put pieces together with merge_pieces before storing them")))
        logs = logs.withColumn("id", F.coalesce(whole.cast("bigint"), F.col("id")))
    blocks = logs.select(*LOGS.fieldNames(), F.shiftright("id", BLOCK_BITS).alias("_block"))
    ordered = blocks.repartition(*PARTITIONS, "_block").sortWithinPartitions(*PARTITIONS, "id").drop("_block")
    ordered.write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGS).parquet(path).select(LOGS.fieldNames())
