"""Captured log text as frames of (device, seq, value).

Layout: ``<path>/device=<name>/<file>``, or one device's files right under the
path. Files of a device are read in order of their path.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfold.plans.size import MAX_BROADCAST_ROWS, few_rows, small_side

# Every file gets as many positions as it has bytes plus one full partition,
# since a row number counts within its partition.
ROW_BITS = 33
SCHEMA = "value string, device string"


def _text(reader, path: str, device: str | None) -> DataFrame:
    """One row per line: split at newlines only, one trailing carriage return removed."""
    schema = "value string" if device is not None else SCHEMA
    df = reader.format("text").schema(schema).option("lineSep", "\n").load(path)
    value = F.col("value")
    framed = F.when(value.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(value)
    return df.select(
        (F.col("device") if device is None else F.lit(device)).alias("device"),
        framed.alias("value"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _with_seq(df: DataFrame, files: DataFrame, small: bool | None = None) -> DataFrame:
    """Number the lines in order of (path, offset) without sorting or counting them.

    ``seq`` = first position of the file + offset of the split + row number in
    the task. Splits of full size are alone in their task, so row numbers of a
    file's splits never overlap; a file's last split may share a task, which
    its file's extra positions allow for. ``files`` has a row per file.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    base = files.select("_path", "_base")
    numbered = df.withColumn("_row", row)
    joined = numbered.join(small_side(base, few_rows(base) if small is None else small), "_path", "left")
    return joined.select("device", (F.col("_base") + F.col("_start") + F.col("_row")).alias("seq"), "value")


def _bases(files: DataFrame) -> DataFrame:
    """First position of every file among its device's; ``files`` has device, _path and _size."""
    earlier = Window.partitionBy("device").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.col("_size") + F.lit(1 << ROW_BITS)
    return files.select("_path", F.coalesce(F.sum(slot).over(earlier), F.lit(0)).alias("_base"))


def read_lines(spark: SparkSession, path: str, device: str | None = None) -> DataFrame:
    """The lines under a path in arrival order; files are listed, not opened, to place them."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = listing.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    # A device may have files in several folders below its own; without a device folder, all are one device's.
    folder = F.lit("") if device is not None else F.regexp_extract("_path", r"\A.*/device=([^/]*)/", 1)
    files = files.withColumn("device", folder)
    return _with_seq(_text(spark.read, path, device), _bases(files))


def stream_lines(spark: SparkSession, path: str, device: str | None = None, **options) -> DataFrame:
    """New files under a path as a stream, for `streaming.ingest.start_ingest`.

    Files should arrive in order of time, as a capture that rotates writes them.
    """
    return _text(spark.readStream.options(**options), path, device)


def batch_lines(batch: DataFrame) -> DataFrame:
    """One micro-batch of `stream_lines` as (device, seq, value)."""
    files = batch.select("device", "_path", "_size").distinct()
    few = files.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(few) > MAX_BROADCAST_ROWS:
        return _with_seq(batch, _bases(files), small=False)
    # A list of bounded size that is known now, so that it is not worked out again with every use of the lines.
    return _with_seq(batch, _bases(batch.sparkSession.createDataFrame(few, "device string, _path string, _size bigint")), small=True)


def of_device(df: DataFrame, device: str) -> DataFrame:
    """The rows of one device (partition pruning on stored data)."""
    return df.filter(F.col("device") == device)
