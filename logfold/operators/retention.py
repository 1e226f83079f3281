"""Retention: keep the newest sessions, then the newest records, of each device.

Both cuts come from one histogram: per device, session and 64 neighbouring ids the ids that exist, as a bitmap of one
number. It is built with partial sums before the shuffle and has a row per 64 records at most. From it follow the
smallest session to keep, the block and at last the very id of the cut; the records themselves are read once for
the histogram and once to be filtered in place, and never sorted.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.plans.scan import BITS, BUCKET, carry
from logfold.plans.size import few_rows, small_side

# Ids of a histogram row: as many as a number has bits.
WORD_BITS = 6


@dataclass(frozen=True)
class RetentionPolicy:
    """Limits of zero or less switch a step off."""

    max_logs: int = 10_000
    max_sessions: int = 3
    cleanup_interval: int = 30

    def checked(self) -> "RetentionPolicy":
        """The policy, if it is one a user may set."""
        for name, least, message in LEAST:
            if getattr(self, name) < least:
                raise ValueError(message)
        return self


# Smallest limits and their messages.
LEAST = [
    ("max_logs", 100, "max_logs must be at least 100"),
    ("max_sessions", 1, "max_sessions must be at least 1"),
    ("cleanup_interval", 5, "cleanup_interval must be at least 5 seconds"),
]


def policy_errors(policies: DataFrame) -> DataFrame:
    """Policies, one per row, with ``error``: what `RetentionPolicy.checked` would say, null if they may be set."""
    found = [F.when(F.col(name) < least, message) for name, least, message in LEAST]
    return policies.withColumn("error", F.coalesce(*found))


def few_devices(logs: DataFrame) -> bool:
    """True if one row per device is safe to broadcast; stored records have their devices in the names of folders."""
    return few_rows(logs.select("device").distinct())


def _histogram(logs: DataFrame) -> DataFrame:
    """(device, session_id, word, ids): bit n of ``ids`` stands for id 64 * word + n."""
    bit = F.expr(f"shiftleft(1L, cast(id & {(1 << WORD_BITS) - 1} as int))")
    return logs.select("device", "session_id", F.shiftright("id", WORD_BITS).alias("word"), bit.alias("_bit")).groupBy(
        "device", "session_id", "word").agg(F.bit_or("_bit").alias("ids"))


def _session_floors(histogram: DataFrame, max_sessions: int) -> DataFrame:
    """(device, session_floor) of every device: its smallest session to keep."""
    newest = Window.partitionBy("device").orderBy(F.desc("session_id"))
    # All columns are used, here as below, so that both read one exchange.
    sessions = histogram.groupBy("device", "session_id").agg(F.bit_or(F.col("ids")).alias("_any"), F.max("word").alias("_word"))
    ranked = sessions.filter("_any <> 0 and _word is not null").withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= max_sessions).groupBy("device").agg(F.min("session_id").alias("session_floor"))


def _nth_highest(ids: Column, n: Column) -> Column:
    """The place of the n-th highest bit that is set."""
    places = F.filter(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda k: F.getbit(ids, k) == 1)
    return F.get(places, (n - 1).cast("int"))


def _id_floors(words: DataFrame, max_logs: int, bits: int) -> DataFrame:
    """(device, id_floor) of the devices with more records; ``words`` (device, word, ids) has one row per device and word.

    Blocks of words are counted from the newest on, then the words of the block with the cut.
    """
    block = F.bitwise_not(F.shiftright("word", max(bits - WORD_BITS, 0))).alias(BUCKET)
    words = words.select("device", "word", "ids", block, F.bit_count("ids").cast("bigint").alias("n"))
    counts = carry(words.groupBy("device", BUCKET).agg(F.sum("n").alias("rows")), ["device"], {"rows": "sum"}, bits)
    newer = F.coalesce("before_rows", F.lit(0))
    cut = counts.filter((newer < max_logs) & (newer + F.col("rows") >= max_logs)).select("device", BUCKET, (F.lit(max_logs) - newer).alias("_left"))
    along = Window.partitionBy("device").orderBy(F.desc("word"))
    here = words.join(cut, ["device", BUCKET]).withColumn("_upto", F.sum("n").over(along))
    last = here.filter("_upto >= _left and _upto - n < _left")
    place = _nth_highest(F.col("ids"), F.col("_left") - (F.col("_upto") - F.col("n")))
    return last.select("device", (F.shiftleft("word", WORD_BITS) + place).alias("id_floor"))


def retention_floors(logs: DataFrame, max_sessions: int, max_logs: int, small: bool | None = None, bits: int = BITS) -> DataFrame:
    """(device, session_floor, id_floor): a record stays at or above both; null keeps all. Limits of zero or less give null."""
    small = few_devices(logs) if small is None else small
    histogram = _histogram(logs)
    if max_sessions > 0:
        sessions = _session_floors(histogram, max_sessions)
        kept = histogram.join(small_side(sessions, small), "device").filter(F.col("session_id") >= F.col("session_floor"))
    else:
        sessions, kept = None, histogram
    if max_logs <= 0:
        return sessions.withColumn("id_floor", F.lit(None).cast("bigint")) if sessions is not None else (
            histogram.select("device").distinct().select("device", *[F.lit(None).cast("bigint").alias(c) for c in ("session_floor", "id_floor")]))
    # Neighbouring ids can lie in several sessions.
    words = kept.groupBy("device", "word").agg(F.bit_or("ids").alias("ids"))
    floors = _id_floors(words, max_logs, bits)
    if sessions is None:
        return floors.select("device", F.lit(None).cast("bigint").alias("session_floor"), "id_floor")
    return sessions.join(floors, "device", "left")


def _kept(logs: DataFrame, max_sessions: int, max_logs: int, small: bool | None, bits: int) -> DataFrame:
    if max_sessions <= 0 and max_logs <= 0:
        return logs
    small = few_devices(logs) if small is None else small
    joined = logs.join(small_side(retention_floors(logs, max_sessions, max_logs, small, bits), small), "device", "left")
    above = lambda column, floor: F.col(floor).isNull() | (F.col(column) >= F.col(floor))
    return joined.filter(above("session_id", "session_floor") & above("id", "id_floor")).select(logs.columns)


def keep_sessions(logs: DataFrame, max_sessions: int, small: bool | None = None) -> DataFrame:
    """Keep the sessions with the ``max_sessions`` largest ids of each device."""
    return _kept(logs, max_sessions, 0, small, BITS)


def keep_rows(logs: DataFrame, max_logs: int, small: bool | None = None, bits: int = BITS) -> DataFrame:
    """Keep the ``max_logs`` records with the largest ids of each device; ids are unique in a device."""
    return _kept(logs, 0, max_logs, small, bits)


def apply_retention(logs: DataFrame, policy: RetentionPolicy = RetentionPolicy(), small: bool | None = None, bits: int = BITS) -> DataFrame:
    """Sessions first, then records among what is left."""
    return _kept(logs, policy.max_sessions, policy.max_logs, small, bits)
