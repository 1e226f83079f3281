"""Parsing of ``threadtime`` lines with built-in expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of a `threadtime` line.
TIMESTAMP_BYTES = 18
HEADER = r"\A *+([0-9]++) *+([0-9]++) *+([VDIWEF]) *+"
TAG_END = ": "
# A whole line behind its timestamp: header, then a tag that is not blank and
# ends at the first ": ".
LINE = r"(?sU)\A *+[0-9]++ *+[0-9]++ *+[VDIWEF]\s*+(?!: )\S.*?: "
LEVELS = ("V", "D", "I", "W", "E", "F")

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

FIELDS = ["ts", "level", "tag", "pid", "tid", "msg"]


def timestamp_of(value: Column) -> Column:
    """The first 18 bytes of the line, kept as text."""
    return F.substring(value.cast("binary"), 1, TIMESTAMP_BYTES).cast("string")


def to_long(digits: Column) -> Column:
    """A digit string as bigint, 0 when empty or out of range."""
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _behind_timestamp(value: Column) -> Column:
    return F.substring(value.cast("binary"), TIMESTAMP_BYTES + 1, 2**31 - 1).cast("string")


def is_log_line(value: Column) -> Column:
    """True where the text is a log line.

    The pattern is possessive, so one number cannot be split into a pid and a
    tid. A timestamp cut that lands inside a multi-byte character leaves a
    stray byte in front of the header, which then does not match.
    """
    return _behind_timestamp(value).rlike(LINE)


def _trim(text: Column) -> Column:
    """Trim white space; the full set is searched only where an end is not plain ASCII."""
    plain = F.trim(text)
    ends = [F.ascii(plain), F.ascii(F.substring(plain, -1, 1))]
    graphic = ends[0].between(33, 126) & ends[1].between(33, 126)
    return F.when(graphic, plain).otherwise(F.btrim(plain, F.lit(WHITE_SPACE)))


def with_fields(lines: DataFrame) -> DataFrame:
    """Add ts, level, tag, pid, tid, msg to rows whose ``value`` is a log line.

    One pattern pass turns the header into "pid tid level"; everything else is
    cut by position.
    """
    fields = {
        "ts": timestamp_of(F.col("value")),
        "level": F.expr("substring(_rest, _tid_end + 1, 1)"),
        "tag": _trim(F.substring_index("_body", TAG_END, 1)),
        "pid": to_long(F.expr("substring(_rest, 1, _pid_end - 1)")),
        "tid": to_long(F.expr("substring(_rest, _pid_end + 1, _tid_end - _pid_end - 1)")),
        "msg": F.expr(f"substring(_body, instr(_body, '{TAG_END}') + {len(TAG_END)})"),
    }
    return (
        lines.withColumn("_rest", F.regexp_replace(_behind_timestamp(F.col("value")), HEADER, "$1 $2 $3"))
        .withColumn("_pid_end", F.instr("_rest", " "))
        .withColumn("_tid_end", F.expr("locate(' ', _rest, _pid_end + 1)"))
        .withColumn("_body", F.expr("substring(_rest, _tid_end + 2)"))
        .select(*lines.columns, *[column.alias(name) for name, column in fields.items()])
    )


def log_lines(lines: DataFrame) -> DataFrame:
    """The lines that are log lines, unparsed (what a shuffle should carry)."""
    return lines.filter(is_log_line(F.col("value")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines that are not log lines."""
    return lines.filter(~is_log_line(F.col("value")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The lines that are log lines, with their fields."""
    return with_fields(log_lines(lines))
