"""Streaming ingest: every micro-batch is one distributed, chained ingest run.

The late and duplicate rules are row-exact and a restart may come at any line,
so a watermark or a state store keyed by device would put a busy device into
one task. Here a micro-batch runs the same bucketed plan as a batch job, and
what it has to remember is one row per device plus the lines taken at the
newest timestamp. The text of a batch is read once and kept while the batch runs.

Layout under ``out``: ``pieces/batch=N``, ``seen/batch=N`` and ``position/batch=N``,
written in this order. A batch counts once its position is there. A batch that
was cut short runs again with the same number and overwrites what it left. Pieces that go on with a record of an
earlier batch lie in a folder of their own (``continues=true``), so that what is to be put together is known
from names of folders. `streaming.cleanup` adds snapshots, which take the place of the batches up to theirs.
"""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from logfold.operators.ingest import IngestState, ingest, next_position, next_seen, reset_position, with_continued
from logfold.operators.retention import RetentionPolicy, apply_retention
from logfold.plans.scan import BITS
from logfold.plans.size import MAX_BROADCAST_BYTES
from logfold.schema import LOG_COLUMNS, LOGS, PIECES, POSITION, SEEN
from logfold.sources import files
from logfold.sources.lines import batch_lines
from logfold.sources.logs import read_logs, write_logs

START = -1
WHOLE, GOING_ON = "continues=false", "continues=true"


def _part(out: str, name: str, batch: int) -> str:
    return f"{out}/{name}/batch={batch}"


def state_after(spark: SparkSession, out: str, batch: int) -> IngestState | None:
    """The state a batch left behind; none before the first batch of a fresh folder."""
    try:
        return IngestState(
            spark.read.schema(POSITION).parquet(_part(out, "position", batch)),
            spark.read.schema(SEEN).parquet(_part(out, "seen", batch)),
        )
    except AnalysisException as error:
        if batch == START and "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _write_state(out: str, batch: int, position: DataFrame, seen: DataFrame) -> None:
    seen.write.mode("overwrite").parquet(_part(out, "seen", batch))
    position.write.mode("overwrite").parquet(_part(out, "position", batch))


def ingest_batch(lines: DataFrame, out: str, batch: int, package: str | None = None, bits: int = BITS) -> None:
    """Run one batch of lines (device, seq, value) and leave its pieces and state under ``out``."""
    spark = lines.sparkSession
    state = state_after(spark, out, batch - 1)
    found = ingest(lines, package, state=state, bits=bits)
    found.write.mode("overwrite").partitionBy("continues").parquet(_part(out, "pieces", batch))
    pieces = spark.read.schema(PIECES).parquet(_part(out, "pieces", batch))
    position = next_position(pieces, state and state.position)
    _write_state(out, batch, position, next_seen(lines, position, state))


def start_ingest(lines: DataFrame, out: str, checkpoint: str, package: str | None = None,
                 bits: int = BITS, after=None, **trigger) -> StreamingQuery:
    """Start ingest of `sources.lines.stream_lines`; stop and start again with the same folders to resume.

    ``after(number)`` is called when a batch is done, see `streaming.cleanup.Cleaner`.
    """

    def run(batch: DataFrame, number: int) -> None:
        # Files, records and the lines to remember all come from this one read.
        batch.persist()
        try:
            ingest_batch(batch_lines(batch), out, number, package, bits)
        finally:
            batch.unpersist()
        if after:
            after(number)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def manifest(spark: SparkSession, out: str) -> dict | None:
    """The snapshot in force: its ``generation``, the last ``batch`` in it and the ``time`` it was made; None before the first."""
    text = files.read_text(spark, f"{out}/snapshot.json")
    return json.loads(text) if text else None


def last_batch(spark: SparkSession, out: str) -> int | None:
    """The last finished batch."""
    return files.last_written(spark, f"{out}/position", "batch")


def _pieces(spark: SparkSession, out: str, batches: list[int], kind: str) -> DataFrame:
    schema = StructType([f for f in PIECES.fields if f.name != "continues"] + [StructField("batch", LongType())])
    found = [f"{out}/pieces/batch={n}/{kind}" for n in batches if kind in files.names(spark, f"{out}/pieces/batch={n}")]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{out}/pieces").parquet(*found)


def logs_until(spark: SparkSession, out: str, last: int | None, held: dict | None) -> DataFrame:
    """The records of snapshot ``held`` and of the batches after it up to ``last``, put together (`schema.LOGS`).

    Which batches have text to append, and how much, is known from folders; no job runs for it.
    """
    first = held["batch"] if held else START - 1
    batches = [n for n in files.numbers(spark, f"{out}/pieces", "batch") if last is not None and first < n <= last]
    whole = _pieces(spark, out, batches, WHOLE).select(LOG_COLUMNS)
    if held:
        whole = read_logs(spark, snapshot_folder(out, held["generation"])).unionByName(whole)
    behind = sum(files.size(spark, f"{out}/pieces/batch={n}/{GOING_ON}") for n in batches)
    if not behind:
        return spark.createDataFrame([], LOGS).unionByName(whole) if not batches and not held else whole
    return with_continued(whole, _pieces(spark, out, batches, GOING_ON), behind <= MAX_BROADCAST_BYTES)


def snapshot_folder(out: str, generation: int) -> str:
    return f"{out}/snapshots/generation={generation}"


def stored_logs(spark: SparkSession, out: str) -> DataFrame:
    """The records of all finished batches, put together (`schema.LOGS`), less those that a cleanup removed."""
    return logs_until(spark, out, last_batch(spark, out), manifest(spark, out))


def compact(spark: SparkSession, out: str, path: str, policy: RetentionPolicy = RetentionPolicy()) -> None:
    """Write the records a policy keeps as a new snapshot; the stream's own files stay."""
    write_logs(apply_retention(stored_logs(spark, out), policy), path, "errorifexists")


def clear(spark: SparkSession, out: str, batch: int, new_out: str) -> None:
    """Start over in a new folder with no records and no newest timestamp.

    ``batch`` is the last finished batch of ``out``. Session and id counters go
    on, so ids are never given twice. Start the stream there with a new checkpoint.
    """
    state = state_after(spark, out, batch)
    _write_state(new_out, START, reset_position(state.position), state.seen.limit(0))
