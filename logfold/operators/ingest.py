"""Order-sensitive ingest: raw lines in, numbered log records out.

Per device, in arrival order: a line older than the newest timestamp so far is
late and dropped; a line already seen at its timestamp is dropped; a restart
marker of the target package opens a new session; neighbours that agree on
(session, level, tag, pid, tid, timestamp) become one record.

The work takes two large shuffles. The first groups equal lines and keeps the
earliest copy (with map-side combine, so a line repeated by a third of the
input costs one row per task). Deduplicating first is exact: later copies of a
late line are late too, and the first copy carries the timestamp that later
copies could have raised. The second spreads the survivors by (device, bucket)
of arrival positions; see `plans.scan` for how buckets learn what came before.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions.parse import log_lines, timestamp_of, with_fields
from logfold.plans.scan import BITS, BUCKET, attach, before, carry, gather_tails, in_bucket, not_null, spread, stitch
from logfold.schema import LOG_COLUMNS

# What marks an app restart.
RESTART_TAGS = ("ActivityManager", "ActivityTaskManager")
RESTART_WORDS = ("Start proc", "Killing", "Force stopping")

KEY = ["level", "tag", "pid", "tid", "ts"]
DEVICE = ["device"]
KEY_TYPE = "struct<level:string,tag:string,pid:bigint,tid:bigint,ts:string>"


@dataclass(frozen=True)
class IngestState:
    """Where an earlier run stopped (`schema.POSITION` and `schema.SEEN`)."""

    position: DataFrame
    seen: DataFrame


def is_restart(tag: Column, message: Column, package: Column) -> Column:
    """True where the line starts or stops the package; case-sensitive substrings."""
    word = F.lit(False)
    for w in RESTART_WORDS:
        word = word | message.contains(w)
    wanted = package.isNotNull() & (package != "") & message.contains(package)
    return F.coalesce(tag.isin(*RESTART_TAGS) & wanted & word, F.lit(False))


def dedup_lines(lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The earliest copy of every distinct line of a device, less those in ``seen``."""
    lines = not_null(lines, DEVICE)
    if seen is None:
        return lines.groupBy("device", "value").agg(F.min("seq").alias("seq"))
    both = lines.select("device", "value", "seq").unionByName(
        seen.select("device", "value", F.lit(None).cast("bigint").alias("seq"))
    )
    counts = both.groupBy("device", "value").agg(
        F.min("seq").alias("seq"), F.count("*").alias("_all"), F.count("seq").alias("_new")
    )
    return counts.filter(F.col("_all") == F.col("_new")).drop("_all", "_new")


def _timely(rows: DataFrame, state: IngestState | None, bits: int, package: str | None = None,
            targets: DataFrame | None = None) -> DataFrame:
    """Spread lines over buckets, parse them and drop the late ones.

    Adds ``package``, the target in force at each line. Target changes travel
    with the lines as marker rows (null value) and are gone from the result.
    """
    line = F.col("value").isNotNull()
    rows = not_null(rows.select("device", "seq", "value"), DEVICE)
    order = ["seq"]
    if targets is not None:
        rows = rows.withColumn("target", F.lit(None).cast("string")).unionByName(
            targets.select(
                "device",
                F.col("from_seq").alias("seq"),
                F.lit(None).cast("string").alias("value"),
                F.col("package").alias("target"),
            )
        )
        order = ["seq", "_line"]
    rows = with_fields(spread(rows, DEVICE, "seq", bits))

    # max over (ts, seq), not ts alone: each branch then reads the same columns
    # of the spread rows, and the exchange is shared.
    stamp = F.struct("ts", "seq") if targets is None else F.when(line, F.struct("ts", "seq"))
    newest = [F.max(stamp)["ts"].alias("ts")]
    kinds = {"ts": "max"}
    if targets is not None:
        newest.append(F.max_by("target", F.when(~line, F.col("seq"))).alias("target"))
        kinds["target"] = "last"
    hi = carry(rows.groupBy("device", BUCKET).agg(*newest), DEVICE, kinds, bits=bits)
    hi = hi.select("device", BUCKET, *[f"before_{c}" for c in kinds])
    if state is not None:
        start = state.position.select("device", F.col("last_ts").alias("_start"))
        hi = hi.join(start, "device", "left").withColumn("before_ts", F.greatest("before_ts", "_start")).drop("_start")

    rows = attach(rows, hi, DEVICE)
    if targets is not None:
        rows = rows.withColumn("_line", line.cast("int"))
    window = in_bucket(DEVICE, *order)
    rows = rows.withColumn("_hi", F.greatest(F.max("ts").over(before(window)), "before_ts"))
    default = F.lit(package).cast("string")
    if targets is None:
        rows = rows.withColumn("package", default)
    else:
        in_force = F.last("target", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("package", F.coalesce(in_force, "before_target", default))
    timely = F.col("_hi").isNull() | (F.col("ts") >= F.col("_hi"))
    kept = rows.filter(timely if targets is None else timely & line)
    return kept.drop("_hi", "before_ts", "before_target", "target", "_line")


def drop_late(lines: DataFrame, state: IngestState | None = None, bits: int = BITS) -> DataFrame:
    """Log lines that are not older than the newest timestamp before them."""
    kept = _timely(log_lines(lines), state, bits)
    return kept.select("device", "seq", "value", *KEY, "msg")


def accept_lines(lines: DataFrame, state: IngestState | None = None, bits: int = BITS) -> DataFrame:
    """Log lines that are neither late nor duplicates."""
    kept = _timely(dedup_lines(log_lines(lines), state and state.seen), state, bits)
    return kept.select("device", "seq", "value", *KEY, "msg")


def _runs(lines, package, targets, state, bits):
    """Accepted lines with their run inside the bucket, and one row of offsets per bucket."""
    rows = _timely(dedup_lines(log_lines(lines), state and state.seen), state, bits, package, targets)
    window = in_bucket(DEVICE, "seq")
    restart = is_restart(F.col("tag"), F.col("msg"), F.col("package"))
    rows = rows.select("device", BUCKET, "seq", "msg", F.struct(*KEY).alias("_key"), restart.alias("restart"))
    rows = rows.withColumns({
        "_prev": F.lag("_key").over(window),
        "_last": F.lead("seq").over(window).isNull(),
        "_session": F.sum(F.col("restart").cast("bigint")).over(window),
    })
    opens = F.col("_prev").isNull() | F.col("restart") | (F.col("_key") != F.col("_prev"))
    rows = rows.withColumn("_opens", opens).withColumn("_run", F.sum(F.col("_opens").cast("bigint")).over(window))
    rows = rows.drop("_prev")

    # A bucket is summed up by the keys of its first and last line; text stays where it is.
    per_bucket = rows.filter((F.col("_run") == 1) | F.col("_last")).groupBy("device", BUCKET).agg(
        F.min_by(F.struct("_key", "restart"), "seq").alias("_first"),
        F.max_by("_key", "seq").alias("last"),
        F.max("_run").alias("runs"),
        F.max("_session").alias("sessions"),
    ).withColumns({"first": F.col("_first._key"), "fresh": F.col("_first.restart")}).drop("_first")
    zero = F.lit(0).cast("bigint")
    if state is None:
        seams = stitch(per_bucket, DEVICE, ["sessions"], bits=bits).withColumns({"id0": zero, "session0": zero})
    else:
        start = state.position.select(
            "device",
            F.coalesce("last_id", zero).alias("id0"),
            F.coalesce("session_id", zero).alias("session0"),
            F.col("last_key").cast(KEY_TYPE).alias("key0"),
        )
        seams = stitch(per_bucket.join(start, "device", "left"), DEVICE, ["sessions"], "key0", bits)
    return rows, seams.withColumns({
        "id0": F.coalesce("id0", zero) + F.col("before_runs"),
        "session0": F.coalesce("session0", zero) + F.col("before_sessions"),
    })


def _text(lines: Column) -> Column:
    """Join (position, msg) structs with newlines, in order of position."""
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["msg"]), "\n")


def _record_id() -> Column:
    return F.col("id0") + F.col("_run") - F.col("joined").cast("bigint")


def sessionize(lines: DataFrame, package: str | None = None, targets: DataFrame | None = None,
               state: IngestState | None = None, bits: int = BITS) -> DataFrame:
    """Accepted lines with ``restart``, ``session_id`` and the ``id`` of their record."""
    rows, seams = _runs(lines, package, targets, state, bits)
    offsets = seams.select("device", BUCKET, "joined", "session0", "id0")
    return attach(rows, offsets, DEVICE).select(
        "device", "seq", _record_id().alias("id"), (F.col("session0") + F.col("_session")).alias("session_id"),
        "restart", "_key.*", "msg",
    )


def ingest(lines: DataFrame, package: str | None = None, targets: DataFrame | None = None,
           state: IngestState | None = None, bits: int = BITS) -> DataFrame:
    """Turn raw lines into log records (`schema.PIECES`).

    ``package`` is the target whose restarts open sessions; ``targets`` (device,
    from_seq, package) changes it from a position on. ``state`` continues an
    earlier run: chained runs give the records of one run over everything, in
    pieces that `merge_pieces` puts together.
    """
    rows, seams = _runs(lines, package, targets, state, bits)

    # The keys told which records cross into a bucket; of these alone the text moves, to where the record begins.
    opening = rows.filter(F.col("_run") == 1).groupBy("device", BUCKET).agg(
        _text(F.collect_list(F.struct("seq", "msg"))).alias("opening"))
    part = F.struct(BUCKET, F.col("opening").alias("msg"))
    offsets = gather_tails(attach(seams, opening, DEVICE), DEVICE, ["session0", "id0"], part, {
        # No parts are not an empty text.
        "tail": lambda parts: F.when(F.count(parts) > 0, _text(F.collect_list(parts)))})
    # The rows are dealt out by bucket already, so this needs no shuffle and is linear in a run's lines.
    opening = F.struct("seq", "_key", "_session")
    record = rows.groupBy("device", BUCKET, "_run").agg(
        F.min_by(opening, "seq").alias("_open"), _text(F.collect_list(F.struct("seq", "msg"))).alias("message"),
    ).select("device", BUCKET, "_run", "_open.*", "message")
    pieces = attach(record, offsets, DEVICE).filter(~(F.col("crossing") & (F.col("_run") == 1)))
    tail = F.when(F.col("_run") == F.col("runs"), F.col("tail"))
    return pieces.select(
        "device",
        _record_id().alias("id"),
        (F.col("session0") + F.col("_session")).alias("session_id"),
        F.col("_key.ts").alias("timestamp"),
        *[F.col(f"_key.{c}").alias(c) for c in KEY[:-1]],
        F.concat_ws("\n", "message", tail).alias("message"),
        "seq",
        (F.col("joined") & (F.col("_run") == 1)).alias("continues"),
    )


def with_continued(whole: DataFrame, continued: DataFrame, small: bool) -> DataFrame:
    """Records (`schema.LOGS`) with the text that later runs went on appending to them.

    ``continued`` has device, id, batch, seq and message: one row per device and run at most, as only a device's
    newest record can go on. ``small`` says that its text fits a broadcast. Else its keys do, and only the few
    records that have such a key meet the text in a shuffle; the others stay in place.
    """
    message = F.concat_ws("\n", "message", "more").alias("message")
    more = continued.groupBy("device", "id").agg(
        _text(F.collect_list(F.struct("batch", "seq", F.col("message").alias("msg")))).alias("more"))
    put_together = lambda rows, side: rows.join(side, ["device", "id"], "left").select(
        *[message if c == "message" else F.col(c) for c in LOG_COLUMNS])
    if small:
        return put_together(whole, F.broadcast(more))
    keys = F.broadcast(continued.select("device", "id").distinct())
    affected = put_together(whole.join(keys, ["device", "id"], "left_semi"), more)
    return affected.unionByName(whole.join(keys, ["device", "id"], "left_anti").select(*LOG_COLUMNS))


def merge_pieces(pieces: DataFrame, small: bool = False) -> DataFrame:
    """Put the pieces of chained runs together into whole records (`schema.LOGS`); see `with_continued`."""
    return with_continued(pieces.filter(~F.col("continues")), pieces.filter("continues"), small)


def next_position(pieces: DataFrame, position: DataFrame | None = None) -> DataFrame:
    """Where ingest stands after a run that wrote these pieces (`schema.POSITION`)."""
    newest = pieces.groupBy("device").agg(
        F.max_by(F.struct("timestamp", "session_id", "id", *KEY[:-1]), "id").alias("r")
    )
    now = newest.select(
        "device",
        F.struct(
            F.col("r.timestamp").alias("last_ts"),
            F.col("r.session_id").alias("session_id"),
            F.col("r.id").alias("last_id"),
            F.struct(*[F.col(f"r.{c}").alias(c) for c in KEY[:-1]], F.col("r.timestamp").alias("ts")).alias("last_key"),
        ).alias("now"),
    )
    if position is None:
        return now.select("device", "now.*")
    old = position.select("device", F.struct("last_ts", "session_id", "last_id", "last_key").alias("old"))
    both = old.join(now, "device", "full")
    return both.select("device", F.coalesce("now", "old").alias("p")).select("device", "p.*")


def next_seen(lines: DataFrame, position: DataFrame, state: IngestState | None = None) -> DataFrame:
    """The lines taken at the newest timestamp after a run (`schema.SEEN`).

    A log line of the run that carries the newest timestamp was either taken or
    a copy of one that was; lines of the run before count if it still stands.
    """
    found = not_null(log_lines(lines), DEVICE).select("device", "value", timestamp_of(F.col("value")).alias("ts"))
    if state is not None:
        old = state.seen.join(state.position.select("device", F.col("last_ts").alias("ts")), "device")
        found = found.unionByName(old)
    newest = position.select("device", F.col("last_ts").alias("ts"))
    return found.join(newest, ["device", "ts"], "left_semi").select("device", "value").distinct()


def reset_position(position: DataFrame) -> DataFrame:
    """Forget the newest timestamp and record; keep session and id counters.

    Used after a clear: lines are taken from any timestamp on and ids are not reused.
    """
    return position.withColumns({
        "last_ts": F.lit(""),
        "last_key": F.when(F.lit(False), F.col("last_key")),
    })
