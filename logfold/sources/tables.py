"""Log lines and log records derived from the test tables, for registered queries and bench."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.operators.ingest import ingest
from logfold.sources.lines import read_lines
from logfold.sources.logs import read_logs, write_logs
from logfold.sources.search_index import read_search_index, write_search_index

PACKAGE = "com.example.app"
# Ids of a block in the search indexes, for tables whose devices have a few thousand records.
SMALL_BLOCKS = 6

# Two SQL dialects share this text; only the timestamp differs.
RAW_LINES = """
SELECT event_id AS seq, concat('dev', cast(user_id % 4 as string)) AS device,
 concat({ts}, '  ', cast(1000 + user_id % 2 as string), '  ', cast(2000 + user_id % 2 as string), ' ',
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'F' ELSE 'E' END
       WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'W' WHEN 'click' THEN 'D' ELSE 'V' END, ' ',
  CASE event_type WHEN 'signup' THEN 'ActivityManager' ELSE concat('Tag_', event_type) END, ' : ',
  CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN 'Start proc com.example.app for activity'
       WHEN event_type = 'signup' THEN 'Start proc com.other for activity'
       ELSE concat(event_type, ' item', cast(event_id % 3 as string)) END) AS value
FROM {events}
"""
LATE = "ts + INTERVAL '1' DAY - CASE WHEN event_id % 11 = 0 THEN INTERVAL '2' HOUR ELSE INTERVAL '0' HOUR END"
SPARK_TS = f"date_format({LATE}, \"MM-dd HH':00:00.000'\")"
DUCKDB_TS = f"strftime({LATE}, '%m-%d %H:00:00.000')"

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as log lines: equal timestamps within an hour, every 11th line late."""
    sql = RAW_LINES.format(ts=SPARK_TS, events="{events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`, whole texts, as messages; a document in ten has no level and is no log line."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("device"),
        F.col("doc_id").alias("seq"),
        F.concat(
            F.lit("05-01 10:00:00.000  "), F.col("doc_id").cast("string"), F.lit(" "), F.col("n_chars").cast("string"),
            F.when(F.col("doc_id") % 10 == 0, " X ").otherwise(" I "), F.col("lang"), F.lit(" : "), F.col("text"),
        ).alias("value"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as stored records of one device, ids by document."""
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("device"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("session_id"),
        F.lit("05-01 10:00:00.000").alias("timestamp"), F.lit("I").alias("level"), F.col("lang").alias("tag"),
        F.lit(1).cast("bigint").alias("pid"), F.lit(1).cast("bigint").alias("tid"), F.col("text").alias("message"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors reach.

    Without that setting only a session that runs in one process gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="logfold-")
    return f"{root}/{name}-{uuid4().hex}"


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of `event_lines`, ingested and stored once per application."""
    path = _once(spark, sf_dir, "logs",
                 lambda path: write_logs(ingest(event_lines(spark, sf_dir), PACKAGE), path, "errorifexists"))
    return read_logs(spark, path)


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index of `event_logs`, written once per application."""
    path = _once(spark, sf_dir, "index",
                 lambda path: write_search_index(event_logs(spark, sf_dir), path, "errorifexists", SMALL_BLOCKS))
    return read_search_index(spark, path)


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index of `document_logs`, written once per application."""
    path = _once(spark, sf_dir, "document_index",
                 lambda path: write_search_index(document_logs(spark, sf_dir), path, "errorifexists", SMALL_BLOCKS))
    return read_search_index(spark, path)


def write_text(lines: DataFrame, path: str) -> None:
    """Add lines to a capture folder, as one batch of files in order of arrival."""
    ordered = lines.repartitionByRange("device", "seq").sortWithinPartitions("device", "seq")
    ordered.select("device", "value").write.mode("append").partitionBy("device").text(path)


def event_capture(spark: SparkSession, sf_dir: str) -> str:
    """The folder with `event_lines` as captured text."""
    return _once(spark, sf_dir, "capture", lambda path: write_text(event_lines(spark, sf_dir), path))


def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, event_capture(spark, sf_dir))
