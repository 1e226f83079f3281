"""Periodic cleanup: snapshots against retention over everything, what is read, and what stays on disk."""

import pytest

from logfold.operators.retention import RetentionPolicy
from logfold.sources import files
from logfold.streaming import cleanup as module
from logfold.streaming.cleanup import Cleaner, cleanup, is_due
from logfold.streaming.ingest import ingest_batch, logs_until, manifest, stored_logs
from tests.test_streaming import FEEDS, records
from tests.test_streaming import want as wanted

# One device writes a single record of many lines, so that it goes on in every batch.
FEEDS = {**FEEDS, "long": [(i, f"05-01 10:00:00.000  7  8 I Trace : part {i}") for i in range(200)]}
CUTS = [0, 60, 61, 130, 200]


def parts():
    for batch, (a, b) in enumerate(zip(CUTS, CUTS[1:])):
        yield batch, {d: feed[a:b] for d, feed in FEEDS.items()}


def want():
    return wanted(FEEDS)


def kept(rows, policy):
    if policy.max_sessions > 0:
        newest = sorted({r[1] for r in rows})[-policy.max_sessions:]
        rows = [r for r in rows if r[1] in newest]
    return rows[-policy.max_logs:] if policy.max_logs > 0 else rows


@pytest.mark.parametrize("policy", [RetentionPolicy(25, 2, 5)])
def test_snapshots_equal_retention_of_everything(spark, lines_frame, tmp_path, policy):
    out = str(tmp_path / "out")
    for batch, part in parts():
        ingest_batch(lines_frame(part), out, batch, "com.a", bits=4)
        # Not after every batch, so that records go on both behind a snapshot and between batches.
        if batch in (0, 1, 3):
            assert cleanup(spark, out, policy, now=100.0 * batch)
    assert records(stored_logs(spark, out)) == {d: kept(rows, policy) for d, rows in want().items()}
    assert manifest(spark, out)["generation"] == 2 and manifest(spark, out)["batch"] == 3
    assert files.numbers(spark, f"{out}/snapshots", "generation") == [1, 2]
    assert files.numbers(spark, f"{out}/pieces", "batch") == []
    assert files.numbers(spark, f"{out}/position", "batch") == [2, 3]


def test_a_run_reads_the_last_snapshot_and_new_batches_only(spark, lines_frame, tmp_path, monkeypatch):
    out, seen = str(tmp_path / "out"), []
    real = module.logs_until
    monkeypatch.setattr(module, "logs_until", lambda *a: seen.append(real(*a)) or seen[-1])
    for batch, part in parts():
        ingest_batch(lines_frame(part), out, batch, "com.a", bits=4)
        if batch >= 1:
            cleanup(spark, out, RetentionPolicy(30, 3, 5), now=float(batch))
    read = {f.split("/out/")[1].rsplit("/device=", 1)[0].rsplit("/part-", 1)[0] for f in seen[-1].inputFiles()}
    assert read <= {"snapshots/generation=1", "pieces/batch=3/continues=false", "pieces/batch=3/continues=true"} and len(read) >= 2


def test_only_batches_with_text_to_append_are_joined(spark, lines_frame, tmp_path, monkeypatch):
    """No job while the plan is built; continued text comes from folders of its own, by broadcast or, if large, by keys."""
    out = str(tmp_path / "out")
    for batch, part in parts():
        ingest_batch(lines_frame(part), out, batch, "com.a", bits=4)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    logs = stored_logs(spark, out)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    plan = logs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert any("continues=true" in f for f in logs.inputFiles())
    assert records(logs) == want()
    monkeypatch.setattr("logfold.streaming.ingest.MAX_BROADCAST_BYTES", 0)
    assert records(stored_logs(spark, out)) == want()


def test_interval_and_overlap(spark, lines_frame, tmp_path):
    out, clock = str(tmp_path / "out"), [1000.0]
    policy = RetentionPolicy(100, 3, 30)
    cleaner = Cleaner(spark, out, policy, lambda: clock[0])
    started = []
    ingest_batch(lines_frame(FEEDS), out, 0, "com.a")
    for batch in range(5):
        started.append(cleaner(batch))
        cleaner.wait()
        clock[0] += 20
    # At 0, 40 and 80 seconds: the interval is 30.
    assert started == [True, False, True, False, True]
    assert not is_due(spark, out, policy, clock[0] - 15) and is_due(spark, out, policy, clock[0] + 10)
    # While the mark of a run stands, no other runs; one that was left behind is void after a while.
    files.create(spark, f"{out}/cleanup.lock", str(clock[0]))
    assert not cleanup(spark, out, policy, clock[0])
    assert cleanup(spark, out, policy, clock[0] + module.STALE)
    assert records(stored_logs(spark, out)) == {d: kept(rows, policy) for d, rows in want().items()}


def test_a_run_cut_short_leaves_the_old_state(spark, lines_frame, tmp_path, monkeypatch):
    out, policy = str(tmp_path / "out"), RetentionPolicy(20, 2, 5)
    batches = list(parts())
    for batch, part in batches[:2]:
        ingest_batch(lines_frame(part), out, batch, "com.a")
    cleanup(spark, out, policy, now=1.0)
    for batch, part in batches[2:]:
        ingest_batch(lines_frame(part), out, batch, "com.a")
    all_rows = records(logs_until(spark, out, 3, manifest(spark, out)))
    with monkeypatch.context() as patch:
        patch.setattr(files, "swap_in", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cleanup(spark, out, policy, now=2.0)
    assert records(stored_logs(spark, out)) == all_rows
    assert cleanup(spark, out, policy, now=3.0)
    # A last batch that runs again after its snapshot adds nothing twice.
    ingest_batch(lines_frame(batches[3][1]), out, 3, "com.a")
    assert records(stored_logs(spark, out)) == {d: kept(rows, policy) for d, rows in want().items()}


def test_nothing_to_clean(spark, tmp_path):
    out = str(tmp_path / "out")
    assert cleanup(spark, out, RetentionPolicy()) and manifest(spark, out) is None
    assert stored_logs(spark, out).count() == 0
