"""Readable reports: records and runs as Markdown text.

`render_*` add a ``text`` column to every row, over a history of any length.
The functions named ``*_report`` answer one question of one device with a one-row frame.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.functions.text import clock, first_line, indent_trace, trace
from logfold.operators.lookup import CONTEXT_LINES, DEFAULT_LIMIT, log_context, query_logs, search_logs
from logfold.operators.retention import RetentionPolicy
from logfold.operators.summaries import TOP_ERRORS, TOP_TAGS, error_summary, status, tag_summary
from logfold.plans.scan import BITS, with_previous
from logfold.streaming.ingest import clear

# Rows that one page may hold; longer listings are frames of `render_entries` or `render_folded`.
PAGE_ROWS = 10_000

# Headings, notes and the texts for empty results.
ERROR_HEADING = "### Error Summary (Current Session)\n"
TAG_HEADING = "### Tag Summary (Current Session)\n"
STATUS_HEADING = "### Status Dashboard\n"
NO_ERRORS = "No errors found in current session."
NO_TAGS = "No logs found in current session."
NO_LOGS = "No logs found matching criteria in the current session."
NO_MATCH = "No logs found matching the query."
NO_CONTEXT = "Log entry not found."
CAPPED = "\n*Note: Output capped at the most recent results. Use a more specific query if needed.*"
CLEARED = "All logs have been cleared successfully (DB and Device)."
ACTIVE = "🟢 Active"
INACTIVE = "🔴 Inactive"


def _with_previous(df: DataFrame, position: str, columns: list[str], limited: bool, bits: int) -> DataFrame:
    if not limited:
        return with_previous(df, ["device"], position, columns, bits)
    window = Window.partitionBy("device").orderBy(position)
    return df.withColumn("prev", F.lag(F.struct(*columns)).over(window))


def _heading(changed: Column) -> Column:
    return F.when(changed, F.concat(F.lit("### "), F.col("_header"), F.lit("\n"))).otherwise("")


def _header() -> Column:
    return F.format_string("%s (%d)", "tag", "pid")


def render_entries(df: DataFrame, position: str = "id", center: Column | None = None, limited: bool = False,
                   bits: int = BITS) -> DataFrame:
    """Records under a heading per source and a sub-heading per message, in order of ``position``.

    ``limited`` says that a limit bounds the rows, which saves the bucketed scan.
    """
    df = df.withColumns({"_header": _header(), "_first": first_line(F.col("message"))})
    df = _with_previous(df, position, ["_header", "_first"], limited, bits)
    changed = F.col("prev").isNull() | (F.col("prev._header") != F.col("_header"))
    shown = F.when(changed, "").otherwise(F.col("prev._first"))
    mark = F.lit("- ") if center is None else F.when(F.col("id") == center, "> - ").otherwise("- ")
    text = F.concat(
        _heading(changed),
        F.when(F.col("_first") != shown, F.concat(F.lit("#### "), F.col("_first"), F.lit("\n"))).otherwise(""),
        mark,
        F.format_string("[%d] **%s** %s\n", F.col("id"), F.col("level"), clock(F.col("timestamp"))),
        indent_trace(trace(F.col("message"))),
    )
    return df.withColumn("text", text).drop("_header", "_first", "prev")


def render_folded(df: DataFrame, position: str = "_age", limited: bool = False, bits: int = BITS) -> DataFrame:
    """Runs under a heading per source, newest first unless a position is given."""
    if position == "_age":
        df = df.withColumn("_age", -F.col("end_id"))
    df = _with_previous(df.withColumn("_header", _header()), position, ["_header"], limited, bits)
    changed = F.col("prev").isNull() | (F.col("prev._header") != F.col("_header"))
    many = F.format_string(
        "- [%d-%d] **%s** %s - %s %s (%dx)\n", F.col("start_id"), F.col("end_id"), F.col("level"),
        clock(F.col("start_time")), clock(F.col("end_time")), first_line(F.col("message")), F.col("count"),
    )
    one = F.format_string(
        "- [%d] **%s** %s %s\n", F.col("start_id"), F.col("level"), clock(F.col("start_time")),
        first_line(F.col("message")),
    )
    text = F.concat(_heading(changed), F.when(F.col("count") > 1, many).otherwise(one))
    return df.withColumn("text", text).drop("_header", "prev")


def _bounded(rows: int) -> int:
    if not 0 <= rows <= PAGE_ROWS:
        raise ValueError(f"a page holds 0 to {PAGE_ROWS} rows; use render_entries or render_folded for more")
    return rows


def _page(rows: DataFrame, order: list[Column | str], empty: str, before: str = "", limit: int | None = None) -> DataFrame:
    """The text of a limited result as one row, or the text for an empty one.

    With ``limit``, rows beyond it are left out and a note says so.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    shown = parts if limit is None else F.slice(parts, 1, limit)
    body = F.array_join(F.transform(shown, lambda p: p["text"]), "")
    after = F.lit("") if limit is None else F.when(F.size(parts) > limit, CAPPED).otherwise("")
    page = F.when(body == "", empty).otherwise(F.concat(F.lit(before), body, after))
    return rows.agg(page.alias("text"))


def error_report(logs: DataFrame, device: str, session_id: int | None = None, k: int = TOP_ERRORS) -> DataFrame:
    rows = error_summary(logs, device, session_id, _bounded(k))
    text = F.format_string("- [%d] **%dx** [%s] %s\n", "last_id", "count", "tag", "message")
    order = [(-F.col("count")).alias("_o"), "tag", "message"]
    return _page(rows.withColumn("text", text), order, NO_ERRORS, ERROR_HEADING)


def tag_report(logs: DataFrame, device: str, session_id: int | None = None, k: int = TOP_TAGS) -> DataFrame:
    rows = tag_summary(logs, device, session_id, _bounded(k))
    text = F.format_string("- **%d** %s\n", "count", "tag")
    return _page(rows.withColumn("text", text), [(-F.col("count")).alias("_o"), "tag"], NO_TAGS, TAG_HEADING)


def _listing(rows: DataFrame, fold: bool, empty: str, limit: int | None = None) -> DataFrame:
    if fold:
        return _page(render_folded(rows, limited=True), ["_age"], empty, limit=limit)
    aged = rows.withColumn("_age", -F.col("id"))
    return _page(render_entries(aged, "_age", limited=True), ["_age"], empty, limit=limit)


def query_report(logs: DataFrame, device: str, session_id: int | None = None, level: str = "", tag: str = "",
                 limit: int = DEFAULT_LIMIT, fold: bool = True) -> DataFrame:
    return _listing(query_logs(logs, device, session_id, level, tag, _bounded(limit), fold), fold, NO_LOGS)


def search_report(logs: DataFrame, device: str, query: str, limit: int = DEFAULT_LIMIT, fold: bool = True) -> DataFrame:
    """The newest hits; one more is looked for, to tell whether some were left out."""
    return _listing(search_logs(logs, device, query, _bounded(limit) + 1, fold), fold, NO_MATCH, limit)


def context_report(logs: DataFrame, device: str, log_id: int, lines: int = CONTEXT_LINES) -> DataFrame:
    if log_id == 0:
        raise ValueError("Invalid log_id")
    _bounded(2 * lines + 1)
    rows = log_context(logs, device, log_id, lines)
    return _page(render_entries(rows, "id", F.lit(log_id), limited=True), ["id"], NO_CONTEXT)


def status_report(logs: DataFrame, device: str, package: str | None = None, query: StreamingQuery | None = None) -> DataFrame:
    row = status(logs, device, package, query)
    text = F.format_string(
        STATUS_HEADING + "- **Target Package**: %s\n- **Session ID**: %d\n- **Watcher Status**: %s\n"
        "- **Connected Device**: %s\n- **Current Session Logs**: %d rows\n",
        F.col("target_package"), F.col("session_id"), F.when(F.col("is_active"), ACTIVE).otherwise(INACTIVE),
        F.col("device"), F.col("session_rows"),
    )
    return row.select(text.alias("text"))


def clear_report(spark: SparkSession, out: str, batch: int, new_out: str) -> str:
    """Clear stored records (`streaming.ingest.clear`) and say so."""
    clear(spark, out, batch, new_out)
    return CLEARED


def target_report(package: str) -> str:
    """Check a target package and say what follows."""
    if not package:
        raise ValueError("Invalid package name")
    return f"Now tracking sessions for: {package}"


def policy_report(policy: RetentionPolicy) -> str:
    """Check a policy and say what it is."""
    policy.checked()
    return (
        f"Retention policy configured:\n- **Max Logs**: {policy.max_logs}\n- **Max Sessions**: {policy.max_sessions}\n"
        f"- **Cleanup Interval**: {policy.cleanup_interval} seconds"
    )
