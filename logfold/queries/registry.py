"""Registered queries over the test tables, each next to the SQL that must agree with it."""

from functools import reduce

from pyspark.sql import functions as F

from logfold.functions.parse import parse_lines, rejected_lines
from logfold.operators import report
from logfold.operators.fold import fold_logs, fold_runs
from logfold.operators.ingest import accept_lines, drop_late, ingest, sessionize
from logfold.operators.lookup import contexts, log_context, log_count, matching, query_logs, search_logs
from logfold.operators.retention import RetentionPolicy, apply_retention, keep_rows, keep_sessions, policy_errors
from logfold.operators.summaries import (
    error_summary, error_summary_all, last_timestamp, session_count, sessions, status, tag_summary, tag_summary_all,
    total_count,
)
from logfold.plans.scan import with_row_number
from logfold.sources.lines import stream_lines
from logfold.sources.tables import (
    DUCKDB_TS, PACKAGE, RAW_LINES, SMALL_BLOCKS, captured_lines, document_index, document_lines, document_logs, event_index,
    event_lines, event_logs, scratch, table, write_text,
)
from logfold.streaming.cleanup import Cleaner
from logfold.streaming.ingest import ingest_batch, last_batch, start_ingest, state_after, stored_logs

LINE_COLUMNS = ["device", "seq", "ts", "level", "tag", "pid", "tid", "msg"]
DEVICE = "dev1"
CHANGES = [("dev0", 2000, "com.other"), ("dev2", 0, "com.other"), ("dev2", 5000, ""), ("dev3", 3000, "com.other")]
STREAM_PARTS = 4
CONTEXT = 3
POLICY = RetentionPolicy(max_logs=150, max_sessions=10, cleanup_interval=30)

RAW = "raw AS (" + RAW_LINES.format(ts=DUCKDB_TS, events="events") + ")"
PARSED = """p AS (SELECT seq, device, value, m.a ts, coalesce(try_cast(m.b as bigint),0) pid, coalesce(try_cast(m.c as bigint),0) tid,
  m.d AS "level", trim(m.e) tag, m.f msg
  FROM (SELECT *, regexp_extract(value, '^(.{18}) *([0-9]+) +([0-9]+) *([VDIWEF]) *(.*?): (.*)$', ['a','b','c','d','e','f'], 's') m FROM raw)
  WHERE m.a <> '' AND trim(m.e) <> '')"""
TIMELY = """p1 AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hi FROM p)
  WHERE hi IS NULL OR ts >= hi)"""
TAKEN = """p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, value ORDER BY seq) rn FROM p1) WHERE rn = 1)"""
NUMBERED = """p3 AS (SELECT *, cast(sum(CASE WHEN tag IN ('ActivityManager','ActivityTaskManager') AND {package} <> '' AND contains(msg,{package})
  AND (contains(msg,'Start proc') OR contains(msg,'Killing') OR contains(msg,'Force stopping')) THEN 1 ELSE 0 END)
  OVER (PARTITION BY device ORDER BY seq) AS bigint) session_id FROM {taken}),
p4 AS (SELECT *, CASE WHEN lag(concat_ws('|',session_id,"level",tag,pid,tid,ts)) OVER (PARTITION BY device ORDER BY seq)
  = concat_ws('|',session_id,"level",tag,pid,tid,ts) THEN 0 ELSE 1 END nw FROM p3),
p5 AS (SELECT *, cast(sum(nw) OVER (PARTITION BY device ORDER BY seq) AS bigint) id FROM p4)"""
LOGS = """logs AS (SELECT device, id, session_id, ts AS "timestamp", "level", tag, pid, tid, string_agg(msg, chr(10) ORDER BY seq) message
  FROM p5 GROUP BY ALL)"""
LINES_CTE = f"WITH {RAW}, {PARSED}, {TIMELY}, {TAKEN}"
NUMBERED_CTE = f"{LINES_CTE}, " + NUMBERED.format(package=f"'{PACKAGE}'", taken="p2")
LOGS_CTE = f"{NUMBERED_CTE}, {LOGS}"
CURRENT = f"device = '{DEVICE}' AND session_id = (SELECT max(session_id) FROM logs WHERE device = '{DEVICE}')"
LOG_COLUMNS = 'device, id, session_id, "timestamp", "level", tag, pid, tid, message'
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(column, text):
    return f"translate({column}, '{UPPER}', '{LOWER}') LIKE translate('%{text}%', '{UPPER}', '{LOWER}')"


def runs_sql(source, keys, position, same):
    """Number the runs of neighbours in ``source`` that agree on ``same``."""
    over = f"OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY {position})"
    changed = " OR ".join(f"lag({c}) {over} IS DISTINCT FROM {c}" for c in same)
    return (f"r1 AS (SELECT *, CASE WHEN row_number() {over} = 1 OR {changed} THEN 1 ELSE 0 END nw FROM {source}), "
            f"r2 AS (SELECT *, sum(nw) {over} run FROM r1)")


SAME_SQL = ['"level"', "tag", "message", "pid"]
FOLDED = (runs_sql("{source}", "device", "id", SAME_SQL) + """, folded AS (SELECT device, min(id) start_id, max(id) end_id,
  arg_min("timestamp", id) start_time, arg_max("timestamp", id) end_time, "level", tag, pid, message, count(*) AS "count"
  FROM r2 GROUP BY device, run, "level", tag, pid, message)""")
CLOCK = "substr({0}, 7)"
HEAD = "split_part(message, chr(10), 1)"
RENDER_ENTRIES = f"""h AS (SELECT *, concat(tag, ' (', pid, ')') header, {HEAD} head, substr(message, length({HEAD}) + 2) tr FROM {{source}}),
h1 AS (SELECT *, lag(header) OVER (PARTITION BY device ORDER BY {{order}}) ph, lag(head) OVER (PARTITION BY device ORDER BY {{order}}) pm FROM h),
rendered AS (SELECT device, id, concat(CASE WHEN ph IS DISTINCT FROM header THEN concat('### ', header, chr(10)) ELSE '' END,
  CASE WHEN head <> (CASE WHEN ph IS DISTINCT FROM header THEN '' ELSE pm END) THEN concat('#### ', head, chr(10)) ELSE '' END,
  {{mark}}, '[', id, '] **', "level", '** ', {CLOCK.format('"timestamp"')}, chr(10),
  CASE WHEN tr = '' THEN '' ELSE concat('  ', replace(tr, chr(10), concat(chr(10), '  ')), chr(10)) END) AS text FROM h1)"""
RENDER_FOLDED = f"""h AS (SELECT *, concat(tag, ' (', pid, ')') header FROM folded),
h1 AS (SELECT *, lag(header) OVER (PARTITION BY device ORDER BY end_id DESC) ph FROM h),
rendered AS (SELECT device, end_id, concat(CASE WHEN ph IS DISTINCT FROM header THEN concat('### ', header, chr(10)) ELSE '' END,
  CASE WHEN "count" > 1 THEN concat('- [', start_id, '-', end_id, '] **', "level", '** ', {CLOCK.format('start_time')}, ' - ',
    {CLOCK.format('end_time')}, ' ', {HEAD}, ' (', "count", 'x)', chr(10))
  ELSE concat('- [', start_id, '] **', "level", '** ', {CLOCK.format('start_time')}, ' ', {HEAD}, chr(10)) END) AS text FROM h1)"""
ERRORS = "\"level\" IN ('E','F')"
TARGETS = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', {s}, '{p}')" for d, s, p in CHANGES) + ") t(device, from_seq, package))"
ANCHORS = f"anchors AS (SELECT device, max(id) center_id FROM logs WHERE {ERRORS} GROUP BY device, session_id, tag, message)"


def top_sessions(n):
    """Sessions kept: rank the distinct sessions of each device."""
    return (f"kept AS (SELECT l.* FROM logs l JOIN (SELECT device, session_id, row_number() OVER (PARTITION BY device "
            f"ORDER BY session_id DESC) rk FROM (SELECT DISTINCT device, session_id FROM logs)) s "
            f"ON l.device = s.device AND l.session_id = s.session_id WHERE s.rk <= {n})")


def top_rows(n, source):
    return (f"SELECT {LOG_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY id DESC) rk "
            f"FROM {source}) WHERE rk <= {n}")


def _error_anchors(logs):
    errors = logs.filter(F.col("level").isin("E", "F"))
    return errors.groupBy("device", "session_id", "tag", "message").agg(F.max("id").alias("id")).select("device", "id")


def _targets(spark):
    return spark.createDataFrame(CHANGES, "device string, from_seq bigint, package string")


def _records(df):
    return df.select("device", "id", "session_id", "timestamp", "level", "tag", "pid", "tid", "message")


def _read_lines(spark, sf):
    """Captured text read back, numbered by line."""
    numbered = with_row_number(captured_lines(spark, sf), ["device"], "seq", "line_no")
    return numbered.select("device", "line_no", "value")


def _arrivals(spark, sf, out, after=None):
    """Captured text arriving in several batches, as a rotating capture hands it over."""
    lines, folder = event_lines(spark, sf), scratch(spark, "arriving")
    step = lines.agg(F.max("seq")).first()[0] // STREAM_PARTS + 1
    for part in range(STREAM_PARTS):
        chunk = lines.filter((F.col("seq") >= part * step) & (F.col("seq") < (part + 1) * step))
        write_text(chunk, folder)
        query = start_ingest(stream_lines(spark, folder), out, f"{out}/checkpoint", PACKAGE, after=after, availableNow=True)
        query.awaitTermination()


def _stream(spark, sf):
    out = scratch(spark, "stream")
    _arrivals(spark, sf, out)
    return stored_logs(spark, out)


def _retention_stream(spark, sf):
    """Batches with a cleanup after each: the clock is one interval further at every batch."""
    out, now = scratch(spark, "cleaned"), [0.0]
    cleaner = Cleaner(spark, out, POLICY, lambda: now[0])

    def after(batch):
        now[0] += POLICY.cleanup_interval
        cleaner(batch)
        cleaner.wait()

    _arrivals(spark, sf, out, after)
    return stored_logs(spark, out)


def _cleared(spark, sf):
    """(folder before, folder after) of all lines ingested and then cleared."""
    old, new = scratch(spark, "full"), scratch(spark, "cleared")
    ingest_batch(event_lines(spark, sf), old, 0, PACKAGE)
    report.clear_report(spark, old, last_batch(spark, old), new)
    return old, new


def _cleared_logs(spark, sf):
    """Records per device before and after a clear."""
    old, new = _cleared(spark, sf)
    left = stored_logs(spark, new).groupBy("device").agg(F.count("*").alias("left"))
    before = stored_logs(spark, old).groupBy("device").agg(F.count("*").alias("before"))
    return before.join(left, "device", "left").select("device", "before", F.coalesce("left", F.lit(0)).alias("left"), F.lit(report.CLEARED).alias("text"))


def _clear_then_ingest(spark, sf):
    """The same lines once more after a clear: records of any timestamp are taken, ids and sessions go on."""
    _, new = _cleared(spark, sf)
    ingest_batch(event_lines(spark, sf), new, 0, PACKAGE)
    return stored_logs(spark, new)


def _reset_positions(spark, sf):
    """Where ingest stands after a clear."""
    _, new = _cleared(spark, sf)
    position = state_after(spark, new, -1).position
    return position.select("device", "last_ts", "session_id", "last_id", F.col("last_key").isNull().alias("starts_new"))


def _policies(spark, sf):
    """Policies made of the numbers of each session, and what setting them says."""
    numbers = sessions(event_logs(spark, sf)).select(
        "device", "session_id", (F.col("rows") * 4).alias("max_logs"), (F.col("session_id") % 4).alias("max_sessions"),
        (F.col("rows") % 9).alias("cleanup_interval"))
    return policy_errors(numbers)


def _empty_reports(spark, sf):
    """Reports that find nothing: a level that no record has, a text in no message, an id beyond all, a device without records."""
    logs = event_logs(spark, sf)
    found = {
        "query": report.query_report(logs, DEVICE, level="X", fold=False), "search": report.search_report(logs, DEVICE, "no such text"),
        "context": report.context_report(logs, DEVICE, 1 << 40), "errors": report.error_report(logs, "absent"), "tags": report.tag_report(logs, "absent"),
    }
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(kind).alias("kind"), "text") for kind, df in found.items()])


# name: (query, SQL). A query without SQL has None.
REGISTERED = {
    "read_lines": (
        _read_lines,
        f"WITH {RAW} SELECT device, row_number() OVER (PARTITION BY device ORDER BY seq) AS line_no, value FROM raw",
    ),
    "parse_lines": (
        lambda spark, sf: parse_lines(event_lines(spark, sf)).select(LINE_COLUMNS),
        f'WITH {RAW}, {PARSED} SELECT device, seq, ts, "level", tag, pid, tid, msg FROM p',
    ),
    "parse_documents": (
        lambda spark, sf: parse_lines(document_lines(spark, sf)).select(LINE_COLUMNS),
        """SELECT source AS device, doc_id AS seq, '05-01 10:00:00.000' AS ts, 'I' AS "level", lang AS tag, doc_id AS pid,
           n_chars AS tid, text AS msg FROM documents WHERE doc_id % 10 <> 0""",
    ),
    "rejected_lines": (
        lambda spark, sf: rejected_lines(document_lines(spark, sf)),
        """SELECT source AS device, doc_id AS seq, concat('05-01 10:00:00.000  ', doc_id, ' ', n_chars, ' X ', lang, ' : ', text) AS value
           FROM documents WHERE doc_id % 10 = 0""",
    ),
    "late_drop": (
        lambda spark, sf: drop_late(event_lines(spark, sf)).select(LINE_COLUMNS),
        f'WITH {RAW}, {PARSED}, {TIMELY} SELECT device, seq, ts, "level", tag, pid, tid, msg FROM p1',
    ),
    "dedup_lines": (
        lambda spark, sf: accept_lines(event_lines(spark, sf)).select(LINE_COLUMNS),
        f'{LINES_CTE} SELECT device, seq, ts, "level", tag, pid, tid, msg FROM p2',
    ),
    "sessionize": (
        lambda spark, sf: sessionize(event_lines(spark, sf), PACKAGE).select("device", "seq", "session_id", "id"),
        f"{NUMBERED_CTE} SELECT device, seq, session_id, id FROM p5",
    ),
    "merge_multiline": (
        lambda spark, sf: _records(ingest(event_lines(spark, sf), PACKAGE)),
        f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs",
    ),
    "target_changes": (
        lambda spark, sf: _records(ingest(event_lines(spark, sf), PACKAGE, targets=_targets(spark))),
        f"{LINES_CTE}, {TARGETS}, aimed AS (SELECT *, coalesce((SELECT arg_max(t.package, t.from_seq) FROM targets t "
        f"WHERE t.device = p2.device AND t.from_seq <= p2.seq), '{PACKAGE}') package FROM p2), "
        + NUMBERED.format(package="package", taken="aimed") + f", {LOGS} SELECT {LOG_COLUMNS} FROM logs",
    ),
    "stream_ingest": (_stream, f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs"),
    "retention_stream": (_retention_stream, f"{LOGS_CTE}, {top_sessions(10)} {top_rows(150, 'kept')}"),
    "cleared_logs": (
        _cleared_logs,
        f"""{LOGS_CTE} SELECT device, count(*) AS "before", cast(0 AS BIGINT) AS "left", 'All logs have been cleared successfully (DB and Device).' AS text
          FROM logs GROUP BY device""",
    ),
    "clear_then_ingest": (
        _clear_then_ingest,
        f"""{LOGS_CTE}, o AS (SELECT device, max(id) i, max(session_id) s FROM logs GROUP BY device)
          SELECT logs.device, id + i AS id, session_id + s AS session_id, "timestamp", "level", tag, pid, tid, message FROM logs JOIN o ON logs.device = o.device""",
    ),
    "reset_positions": (
        _reset_positions,
        f"{LOGS_CTE} SELECT device, '' AS last_ts, max(session_id) AS session_id, max(id) AS last_id, true AS starts_new FROM logs GROUP BY device",
    ),
    "policy_errors": (
        _policies,
        f"""{LOGS_CTE}, pol AS (SELECT device, session_id, count(*) * 4 AS max_logs, session_id % 4 AS max_sessions, count(*) % 9 AS cleanup_interval
          FROM logs GROUP BY device, session_id) SELECT *, CASE WHEN max_logs < 100 THEN 'max_logs must be at least 100'
          WHEN max_sessions < 1 THEN 'max_sessions must be at least 1' WHEN cleanup_interval < 5 THEN 'cleanup_interval must be at least 5 seconds' END AS error FROM pol""",
    ),
    "empty_reports": (
        _empty_reports,
        f"""{LOGS_CTE}, n AS (SELECT count(*) FILTER (WHERE device = '{DEVICE}' AND "level" = 'X') q, count(*) FILTER (WHERE device = '{DEVICE}'
          AND contains(lower(message), 'no such text')) s, count(*) FILTER (WHERE device = '{DEVICE}' AND id > 1000000000) c, count(*) FILTER (WHERE device = 'absent') a FROM logs)
          SELECT 'query' AS kind, 'No logs found matching criteria in the current session.' AS text FROM n WHERE q = 0
          UNION ALL SELECT 'search', 'No logs found matching the query.' FROM n WHERE s = 0
          UNION ALL SELECT 'context', 'Log entry not found.' FROM n WHERE c = 0
          UNION ALL SELECT 'errors', 'No errors found in current session.' FROM n WHERE a = 0
          UNION ALL SELECT 'tags', 'No logs found in current session.' FROM n WHERE a = 0""",
    ),
    "error_summary": (
        lambda spark, sf: error_summary(event_logs(spark, sf), DEVICE),
        f'{LOGS_CTE} SELECT max(id) last_id, tag, message, count(*) AS "count" FROM logs WHERE {CURRENT} AND {ERRORS} '
        f'GROUP BY tag, message ORDER BY "count" DESC, tag, message LIMIT 20',
    ),
    "error_summary_all_sessions": (
        lambda spark, sf: error_summary_all(event_logs(spark, sf)),
        f"""{LOGS_CTE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, session_id ORDER BY "count" DESC, tag, message) AS "rank"
          FROM (SELECT device, session_id, tag, message, max(id) last_id, count(*) AS "count" FROM logs WHERE {ERRORS}
          GROUP BY device, session_id, tag, message)) WHERE "rank" <= 20""",
    ),
    "tag_summary": (
        lambda spark, sf: tag_summary(event_logs(spark, sf), DEVICE),
        f'{LOGS_CTE} SELECT tag, count(*) AS "count" FROM logs WHERE {CURRENT} GROUP BY tag ORDER BY "count" DESC, tag LIMIT 50',
    ),
    "tag_summary_all_sessions": (
        lambda spark, sf: tag_summary_all(event_logs(spark, sf)),
        f"""{LOGS_CTE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, session_id ORDER BY "count" DESC, tag) AS "rank"
          FROM (SELECT device, session_id, tag, count(*) AS "count" FROM logs GROUP BY device, session_id, tag)) WHERE "rank" <= 50""",
    ),
    "query_logs_level_tag": (
        lambda spark, sf: query_logs(event_logs(spark, sf), DEVICE, level="V", tag="tag_V_E"),
        f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs WHERE {CURRENT} AND \"level\" = 'V' AND {like('tag', 'tag_V_E')} ORDER BY id DESC LIMIT 25",
    ),
    "query_logs_folded": (
        lambda spark, sf: query_logs(event_logs(spark, sf), DEVICE, fold=True),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE {CURRENT}), " + FOLDED.format(source="q")
        + " SELECT * FROM folded ORDER BY end_id DESC LIMIT 25",
    ),
    "search_logs": (
        lambda spark, sf: search_logs(event_logs(spark, sf), DEVICE, "ITEM_%item1", limit=50),
        f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs WHERE device = '{DEVICE}' AND {like('message', 'ITEM_%item1')} ORDER BY id DESC LIMIT 50",
    ),
    "search_logs_folded": (
        lambda spark, sf: search_logs(event_logs(spark, sf), DEVICE, "CLICK", limit=50, fold=True),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE device = '{DEVICE}' AND {like('message', 'CLICK')}), "
        + FOLDED.format(source="q") + " SELECT * FROM folded ORDER BY end_id DESC LIMIT 50",
    ),
    "search_index": (
        lambda spark, sf: event_index(spark, sf),
        f"""{LOGS_CTE}, g AS (SELECT device, id, (id >> {SMALL_BLOCKS}) << {SMALL_BLOCKS} first_id, unnest(list_concat([''],
          [substr(m, i, 3) for i in range(1, length(m) - 1)])) gram
          FROM (SELECT *, translate(message, '{UPPER}', '{LOWER}') m FROM logs))
        SELECT device, gram, first_id, first_id + {(1 << SMALL_BLOCKS) - 1} AS last_id, max(id) AS upto FROM g GROUP BY ALL""",
    ),
    "search_logs_indexed": (
        lambda spark, sf: search_logs(event_logs(spark, sf), DEVICE, "Start PROC%example", limit=50, index=event_index(spark, sf)),
        f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs WHERE device = '{DEVICE}' AND {like('message', 'Start PROC%example')} ORDER BY id DESC LIMIT 50",
    ),
    "search_logs_folded_indexed": (
        lambda spark, sf: search_logs(event_logs(spark, sf), DEVICE, "CLICK", limit=50, fold=True, index=event_index(spark, sf)),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE device = '{DEVICE}' AND {like('message', 'CLICK')}), "
        + FOLDED.format(source="q") + " SELECT * FROM folded ORDER BY end_id DESC LIMIT 50",
    ),
    "search_documents_indexed": (
        lambda spark, sf: search_logs(document_logs(spark, sf), "docs", "LICEN_E", limit=-1, index=document_index(spark, sf)).select("id", "tag", "message"),
        f"SELECT doc_id AS id, lang AS tag, text AS message FROM documents WHERE {like('text', 'LICEN_E')}",
    ),
    "search_documents": (
        lambda spark, sf: search_logs(document_logs(spark, sf), "docs", "é", limit=-1).select("id", "tag", "message"),
        f"SELECT doc_id AS id, lang AS tag, text AS message FROM documents WHERE {like('text', 'é')}",
    ),
    "search_documents_pattern": (
        lambda spark, sf: matching(document_logs(spark, sf), tag="E_", query="THE%o_ %IS").select("id", "tag", "message"),
        f"SELECT doc_id AS id, lang AS tag, text AS message FROM documents WHERE {like('lang', 'E_')} AND {like('text', 'THE%o_ %IS')}",
    ),
    "log_context": (
        lambda spark, sf: log_context(event_logs(spark, sf), DEVICE, 100),
        f"{LOGS_CTE} SELECT {LOG_COLUMNS} FROM logs WHERE device = '{DEVICE}' AND id BETWEEN 85 AND 115",
    ),
    "error_contexts": (
        lambda spark, sf: contexts(event_logs(spark, sf), _error_anchors(event_logs(spark, sf)), CONTEXT),
        f"{LOGS_CTE}, {ANCHORS} SELECT l.*, a.center_id, l.id = a.center_id AS is_center FROM anchors a JOIN logs l ON l.device = a.device "
        f"AND l.id BETWEEN greatest(1, a.center_id - {CONTEXT}) AND a.center_id + {CONTEXT}",
    ),
    "fold_runs": (
        lambda spark, sf: fold_logs(event_logs(spark, sf)),
        f"{LOGS_CTE}, " + FOLDED.format(source="logs") + " SELECT * FROM folded",
    ),
    "fold_events": (
        lambda spark, sf: fold_runs(table(spark, sf, "events"), [], "event_id", ["event_type"]),
        "WITH " + runs_sql("events", "", "event_id", ["event_type"]) + ' SELECT event_type, min(event_id) first_event_id, '
        'max(event_id) last_event_id, count(*) AS "count" FROM r2 GROUP BY run, event_type',
    ),
    "fold_roles": (
        lambda spark, sf: fold_runs(table(spark, sf, "conversations"), ["conv_id"], "turn", ["role"]),
        "WITH " + runs_sql("conversations", "conv_id", "turn", ["role"]) + ' SELECT conv_id, role, min(turn) first_turn, '
        'max(turn) last_turn, count(*) AS "count" FROM r2 GROUP BY conv_id, run, role',
    ),
    "log_count": (
        lambda spark, sf: log_count(event_logs(spark, sf), DEVICE),
        f'{LOGS_CTE} SELECT count(*) AS "count" FROM logs WHERE {CURRENT}',
    ),
    "total_count": (
        lambda spark, sf: total_count(event_logs(spark, sf)),
        f'{LOGS_CTE} SELECT device, count(*) AS "rows" FROM logs GROUP BY device',
    ),
    "session_stats": (
        lambda spark, sf: sessions(event_logs(spark, sf)),
        f"""{LOGS_CTE} SELECT device, session_id, min(id) first_id, max(id) last_id, arg_min("timestamp", id) first_time,
          arg_max("timestamp", id) last_time, count(*) AS "rows", count(*) FILTER (WHERE {ERRORS}) AS error_rows FROM logs GROUP BY device, session_id""",
    ),
    "session_count": (
        lambda spark, sf: session_count(event_logs(spark, sf)),
        f"{LOGS_CTE} SELECT device, count(DISTINCT session_id) AS sessions FROM logs GROUP BY device",
    ),
    "retention_sessions": (
        lambda spark, sf: keep_sessions(event_logs(spark, sf), 3),
        f"{LOGS_CTE}, {top_sessions(3)} SELECT {LOG_COLUMNS} FROM kept",
    ),
    "retention_rows": (
        lambda spark, sf: keep_rows(event_logs(spark, sf), 1000),
        f"{LOGS_CTE} {top_rows(1000, 'logs')}",
    ),
    "retention_full": (
        lambda spark, sf: apply_retention(event_logs(spark, sf), RetentionPolicy(max_logs=150, max_sessions=10)),
        f"{LOGS_CTE}, {top_sessions(10)} {top_rows(150, 'kept')}",
    ),
    "last_timestamp": (
        lambda spark, sf: last_timestamp(event_logs(spark, sf)),
        f'{LOGS_CTE} SELECT device, arg_max("timestamp", id) AS last_ts FROM logs GROUP BY device',
    ),
    "status": (
        lambda spark, sf: status(event_logs(spark, sf), DEVICE, PACKAGE).drop("last_poll"),
        f"""{LOGS_CTE} SELECT '{PACKAGE}' AS target_package, (SELECT max(session_id) FROM logs WHERE device = '{DEVICE}') AS session_id,
          false AS is_active, '{DEVICE}' AS device, count(*) AS session_rows FROM logs WHERE {CURRENT}""",
    ),
    "render_entries": (
        lambda spark, sf: report.render_entries(event_logs(spark, sf)).select("device", "id", "text"),
        f"{LOGS_CTE}, " + RENDER_ENTRIES.format(source="logs", order="id", mark="'- '") + " SELECT device, id, text FROM rendered",
    ),
    "render_folded": (
        lambda spark, sf: report.render_folded(fold_logs(event_logs(spark, sf))).select("device", "end_id", "text"),
        f"{LOGS_CTE}, " + FOLDED.format(source="logs") + f", {RENDER_FOLDED} SELECT device, end_id, text FROM rendered",
    ),
    "error_report": (
        lambda spark, sf: report.error_report(event_logs(spark, sf), DEVICE),
        f"""{LOGS_CTE}, e AS (SELECT max(id) last_id, tag, message, count(*) c FROM logs WHERE {CURRENT} AND {ERRORS}
          GROUP BY tag, message ORDER BY c DESC, tag, message LIMIT 20)
          SELECT coalesce('### Error Summary (Current Session)' || chr(10) || string_agg(concat('- [', last_id, '] **', c, 'x** [', tag, '] ', message, chr(10)), ''
          ORDER BY c DESC, tag, message), 'No errors found in current session.') AS text FROM e""",
    ),
    "tag_report": (
        lambda spark, sf: report.tag_report(event_logs(spark, sf), DEVICE),
        f"""{LOGS_CTE}, e AS (SELECT tag, count(*) c FROM logs WHERE {CURRENT} GROUP BY tag ORDER BY c DESC, tag LIMIT 50)
          SELECT coalesce('### Tag Summary (Current Session)' || chr(10) || string_agg(concat('- **', c, '** ', tag, chr(10)), '' ORDER BY c DESC, tag),
          'No logs found in current session.') AS text FROM e""",
    ),
    "query_report": (
        lambda spark, sf: report.query_report(event_logs(spark, sf), DEVICE, fold=False),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE {CURRENT} ORDER BY id DESC LIMIT 25), "
        + RENDER_ENTRIES.format(source="q", order="id DESC", mark="'- '") + " SELECT string_agg(text, '' ORDER BY id DESC) AS text FROM rendered",
    ),
    "search_report": (
        lambda spark, sf: report.search_report(event_logs(spark, sf), DEVICE, "click"),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE device = '{DEVICE}' AND {like('message', 'click')}), "
        + FOLDED.format(source="q").replace("folded AS", "unlimited AS")
        + ", folded AS (SELECT * FROM unlimited ORDER BY end_id DESC LIMIT 25)"
        + f", {RENDER_FOLDED} SELECT string_agg(text, '' ORDER BY end_id DESC) || chr(10) || "
        "'*Note: Output capped at the most recent results. Use a more specific query if needed.*' AS text FROM rendered",
    ),
    "context_report": (
        lambda spark, sf: report.context_report(event_logs(spark, sf), DEVICE, 100),
        f"{LOGS_CTE}, q AS (SELECT * FROM logs WHERE device = '{DEVICE}' AND id BETWEEN 85 AND 115), "
        + RENDER_ENTRIES.format(source="q", order="id", mark="CASE WHEN id = 100 THEN '> - ' ELSE '- ' END")
        + " SELECT string_agg(text, '' ORDER BY id) AS text FROM rendered",
    ),
    "status_report": (
        lambda spark, sf: report.status_report(event_logs(spark, sf), DEVICE, PACKAGE),
        f"""{LOGS_CTE} SELECT concat('### Status Dashboard', chr(10), '- **Target Package**: {PACKAGE}', chr(10), '- **Session ID**: ', max(session_id), chr(10),
          '- **Watcher Status**: 🔴 Inactive', chr(10), '- **Connected Device**: {DEVICE}', chr(10), '- **Current Session Logs**: ', count(*), ' rows', chr(10)) AS text
          FROM logs WHERE {CURRENT}""",
    ),
}


def queries():
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql is not None}
