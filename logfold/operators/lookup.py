"""Filtered queries, search and context windows over log records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.text import ascii_contains
from logfold.operators.fold import fold_entries, fold_logs
from logfold.plans.size import few_rows, small_side
from logfold.sources.search_index import skip_blocks

DEFAULT_LIMIT = 25
CONTEXT_LINES = 15
# Ids that a folded query looks at first, and the most that it folds in one task.
FIRST_SPAN, SPAN_PER_RUN, ONE_WINDOW = 4096, 64, 1 << 18


def current_session(logs: DataFrame, device: str) -> Column:
    """The newest session of a device, as a scalar subquery."""
    return logs.filter(F.col("device") == device).agg(F.max("session_id")).scalar()


def of_session(logs: DataFrame, device: str, session_id: int | None) -> DataFrame:
    session = current_session(logs, device) if session_id is None else F.lit(session_id)
    return logs.filter((F.col("device") == device) & (F.col("session_id") == session))


def newest(logs: DataFrame, limit: int) -> DataFrame:
    """Newest records first; a negative limit keeps all."""
    ordered = logs.orderBy(F.desc("id"))
    return ordered if limit < 0 else ordered.limit(limit)


def _newest_folded(logs: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The newest runs of the records found among a device's, all of them folded; a limit below zero keeps none.

    Ids are read from the newest on: a range of them gives the result as soon as it holds one run more than asked
    for, since only its oldest run can be cut off. Else the range grows eightfold, at last to all ids. Filters on ids
    reach the files, which are sorted by id, so what is older than the result is not read.
    """
    ends = logs.agg(F.min("id"), F.max("id")).first()
    if limit <= 0 or ends[1] is None:
        return fold_entries(found.limit(0), 0)
    span = max(FIRST_SPAN, SPAN_PER_RUN * limit)
    while True:
        whole = ends[1] - span < ends[0]
        part = found if whole else found.filter(F.col("id") > ends[1] - span)
        # A range that one task can sort is folded in one window.
        runs = fold_entries(part, limit + 1) if span <= ONE_WINDOW else fold_logs(part).orderBy(F.desc("end_id")).limit(limit + 1)
        if whole or runs.count() > limit:
            return runs.orderBy(F.desc("end_id")).limit(limit)
        span *= 8


def matching(logs: DataFrame, level: str = "", tag: str = "", query: str = "") -> DataFrame:
    """Records with this level, this text in the tag, this text in the message; "" asks for nothing."""
    if level:
        logs = logs.filter(F.col("level") == level)
    if tag:
        logs = logs.filter(ascii_contains(F.col("tag"), tag))
    if query:
        logs = logs.filter(ascii_contains(F.col("message"), query))
    return logs


def query_logs(logs: DataFrame, device: str, session_id: int | None = None, level: str = "", tag: str = "",
               limit: int = DEFAULT_LIMIT, fold: bool = False) -> DataFrame:
    """Newest records of one session (the current one by default), folded on demand."""
    found = matching(of_session(logs, device, session_id), level, tag)
    return _newest_folded(logs.filter(F.col("device") == device), found, limit) if fold else newest(found, limit)


def search_logs(logs: DataFrame, device: str, query: str, limit: int = DEFAULT_LIMIT, fold: bool = False,
                index: DataFrame | None = None) -> DataFrame:
    """Newest records of a device, in any session, with the text in the message.

    With an ``index`` of the records (`sources.search_index`) blocks of ids that cannot have the text are not read.
    """
    own = logs.filter(F.col("device") == device) if index is None else skip_blocks(logs, index, device, query)
    found = matching(own, query=query)
    return _newest_folded(own, found, limit) if fold else newest(found, limit)


def log_context(logs: DataFrame, device: str, log_id: int, lines: int = CONTEXT_LINES) -> DataFrame:
    """Records with ids around ``log_id``, oldest first. The id itself need not exist."""
    near = F.col("id").between(max(1, log_id - lines), log_id + lines)
    return logs.filter((F.col("device") == device) & near).orderBy("id")


def contexts(logs: DataFrame, anchors: DataFrame, lines: int = CONTEXT_LINES, small: bool | None = None) -> DataFrame:
    """The context of every anchor (device, id) at once, with ``center_id`` and ``is_center``.

    Ids are cut into blocks as wide as one context. An anchor reaches into two
    blocks at most, so this is an equi-join on (device, block) in which a key
    holds no more records than a context does. Anchors whose number is checked (``small``) come to the records,
    which stay where they are; more of them meet the records in a shuffle.
    """
    small = few_rows(anchors) if small is None else small
    span = 2 * lines + 1
    center = F.col("center_id")
    block = lambda column: F.floor(column / F.lit(span))
    reach = anchors.select("device", F.col("id").alias("center_id")).withColumn(
        "_block", F.explode(F.array_distinct(F.array(block(center - lines), block(center + lines))))
    )
    near = F.col("id").between(F.greatest(F.lit(1), center - lines), center + lines)
    found = logs.withColumn("_block", block(F.col("id"))).join(small_side(reach, small), ["device", "_block"]).filter(near)
    return found.select("device", "center_id", *[c for c in logs.columns if c != "device"],
                        (F.col("id") == center).alias("is_center"))


def log_count(logs: DataFrame, device: str, session_id: int | None = None) -> DataFrame:
    return of_session(logs, device, session_id).agg(F.count("*").alias("count"))
