"""Periodic cleanup of a stream's records, one run at a time, without reading the whole history.

A run takes the snapshot in force and the batches that came after it, keeps what the policy keeps, and writes
the next generation. A small file then names it, swapped in by renaming: readers see the old state or the new one.
What the snapshot took in is removed: batches up to its last, their states but for the two that a restart may
need, and generations before the one that was in force until now, which readers may still be at.
"""

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from logfold.operators.retention import RetentionPolicy, apply_retention
from logfold.sources import files
from logfold.sources.logs import write_logs
from logfold.streaming.ingest import last_batch, logs_until, manifest, snapshot_folder

# Seconds after which the mark of a run that ended without taking it away is void.
STALE = 24 * 3600


def _marked(spark: SparkSession, out: str, now: float) -> bool:
    """Set the mark that a run is going on; False if another has it."""
    mark = f"{out}/cleanup.lock"
    if files.create(spark, mark, str(now)):
        return True
    since = files.read_text(spark, mark)
    if since and now - float(since) < STALE:
        return False
    files.remove(spark, mark)
    return files.create(spark, mark, str(now))


def is_due(spark: SparkSession, out: str, policy: RetentionPolicy, now: float | None = None) -> bool:
    """True if the policy's interval has passed since the last run, or there was none."""
    held = manifest(spark, out)
    return held is None or (time.time() if now is None else now) - held["time"] >= policy.cleanup_interval


def cleanup(spark: SparkSession, out: str, policy: RetentionPolicy, now: float | None = None) -> bool:
    """Apply the policy to the records of the finished batches; False if a run is going on already."""
    now = time.time() if now is None else now
    if not _marked(spark, out, now):
        return False
    try:
        held, last = manifest(spark, out), last_batch(spark, out)
        generation = held["generation"] + 1 if held else 0
        if last is not None and (held is None or last > held["batch"] or policy_of(held) != _limits(policy)):
            kept = apply_retention(logs_until(spark, out, last, held), policy)
            # What a run that was cut short has left is overwritten.
            write_logs(kept, snapshot_folder(out, generation), "overwrite")
            held = {"generation": generation, "batch": last, "time": now, "limits": _limits(policy)}
        elif held:
            held["time"] = now
        if held:
            files.swap_in(spark, f"{out}/snapshot.json", json.dumps(held))
            _remove_superseded(spark, out, held)
    finally:
        files.remove(spark, f"{out}/cleanup.lock")
    return True


def _limits(policy: RetentionPolicy) -> list[int]:
    return [policy.max_logs, policy.max_sessions]


def policy_of(held: dict) -> list[int]:
    return held["limits"]


def _remove_superseded(spark: SparkSession, out: str, held: dict) -> None:
    for n in files.numbers(spark, f"{out}/pieces", "batch"):
        if n <= held["batch"]:
            files.remove(spark, f"{out}/pieces/batch={n}")
    for kind in ("seen", "position"):
        for n in files.numbers(spark, f"{out}/{kind}", "batch"):
            if n < held["batch"] - 1:
                files.remove(spark, f"{out}/{kind}/batch={n}")
    for n in files.numbers(spark, f"{out}/snapshots", "generation"):
        if n < held["generation"] - 1:
            files.remove(spark, snapshot_folder(out, n))


class Cleaner:
    """Runs `cleanup` beside a stream: ``start_ingest(..., after=cleaner)`` asks after each batch whether it is time.

    A run goes on in a thread of its own while the stream takes further batches. While it does, no other starts.
    """

    def __init__(self, spark: SparkSession, out: str, policy: RetentionPolicy, clock: Callable[[], float] = time.time):
        self.spark, self.out, self.policy, self.clock = spark, out, policy, clock
        self.error: Exception | None = None
        self._thread: threading.Thread | None = None

    def __call__(self, batch: int | None = None) -> bool:
        """Start a run if one is due and none is going on; True if it was started."""
        now = self.clock()
        if (self._thread and self._thread.is_alive()) or not is_due(self.spark, self.out, self.policy, now):
            return False
        self._thread = threading.Thread(target=self._run, args=(now,), daemon=True)
        self._thread.start()
        return True

    def _run(self, now: float) -> None:
        try:
            cleanup(self.spark, self.out, self.policy, now)
            self.error = None
        except Exception as error:  # a failed run does not end the stream; the next one starts from the same state
            self.error = error

    def wait(self) -> None:
        """Wait for the run that is going on and raise what ended it."""
        if self._thread:
            self._thread.join()
        if self.error:
            raise self.error
