"""Counts by error, tag and session, and the status row."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.operators.lookup import current_session, of_session

ERROR_LEVELS = ("E", "F")
TOP_ERRORS = 20
TOP_TAGS = 50
SESSION = ["device", "session_id"]
NO_PACKAGE = "None (System-wide)"


def _errors(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level").isin(*ERROR_LEVELS))


def _count_errors(logs: DataFrame, *keys: str) -> DataFrame:
    return _errors(logs).groupBy(*keys, "tag", "message").agg(
        F.max("id").alias("last_id"), F.count("*").alias("count")
    )


def _count_tags(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys, "tag").agg(F.count("*").alias("count"))


def _top_per_session(counts: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k largest counts of every session.

    Spark keeps k rows per session in each task before the shuffle, so a session
    with very many groups does not end up in one task.
    """
    window = Window.partitionBy(*SESSION).orderBy(F.desc("count"), *ties)
    ranked = counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def error_summary(logs: DataFrame, device: str, session_id: int | None = None, k: int = TOP_ERRORS) -> DataFrame:
    """Most frequent errors of a session (the current one by default) with their newest id."""
    counts = _count_errors(of_session(logs, device, session_id))
    return counts.orderBy(F.desc("count"), "tag", "message").limit(k)


def error_summary_all(logs: DataFrame, k: int = TOP_ERRORS) -> DataFrame:
    """`error_summary` of every session of every device."""
    return _top_per_session(_count_errors(logs, *SESSION), k, "tag", "message")


def tag_summary(logs: DataFrame, device: str, session_id: int | None = None, k: int = TOP_TAGS) -> DataFrame:
    """Most frequent tags of a session (the current one by default)."""
    counts = _count_tags(of_session(logs, device, session_id))
    return counts.orderBy(F.desc("count"), "tag").limit(k)


def tag_summary_all(logs: DataFrame, k: int = TOP_TAGS) -> DataFrame:
    """`tag_summary` of every session of every device."""
    return _top_per_session(_count_tags(logs, *SESSION), k, "tag")


def sessions(logs: DataFrame) -> DataFrame:
    """One row per session: first and last record, number of records and of errors."""
    error = F.col("level").isin(*ERROR_LEVELS)
    return logs.groupBy(*SESSION).agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.min_by("timestamp", "id").alias("first_time"),
        F.max_by("timestamp", "id").alias("last_time"),
        F.count("*").alias("rows"),
        F.count(F.when(error, 1)).alias("error_rows"),
    )


def session_count(logs: DataFrame) -> DataFrame:
    """Number of distinct sessions of each device."""
    distinct = logs.select(*SESSION).distinct()
    return distinct.groupBy("device").agg(F.count("*").alias("sessions"))


def total_count(logs: DataFrame) -> DataFrame:
    return logs.groupBy("device").agg(F.count("*").alias("rows"))


def last_timestamp(logs: DataFrame) -> DataFrame:
    """Timestamp of the newest record (by id) of each device: where to resume."""
    return logs.groupBy("device").agg(F.max_by("timestamp", "id").alias("last_ts"))


def status(logs: DataFrame, device: str, package: str | None = None, query: StreamingQuery | None = None) -> DataFrame:
    """One row: target package, current session, activity, device, size of the session.

    ``query`` is the running ingest, if there is one.
    """
    progress = query.lastProgress if query is not None else None
    session = F.coalesce(current_session(logs, device), F.lit(0).cast("bigint"))
    rows = of_session(logs, device, None).agg(F.count("*").alias("session_rows"))
    return rows.select(
        F.lit(package or NO_PACKAGE).alias("target_package"),
        session.alias("session_id"),
        F.lit(bool(query is not None and query.isActive)).alias("is_active"),
        F.lit(device).alias("device"),
        "session_rows",
        F.lit(progress["timestamp"] if progress else None).cast("string").alias("last_poll"),
    )
