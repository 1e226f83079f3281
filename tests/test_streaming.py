


from logfold.operators.retention import RetentionPolicy
from logfold.sources.lines import stream_lines
from logfold.sources.logs import read_logs
from logfold.streaming.ingest import clear, compact, ingest_batch, start_ingest, stored_logs
from tests import sequential

FEEDS = {f"d{i}": sequential.feed(20 + i, 200) for i in range(3)}
FIELDS = ["id", "session_id", "timestamp", "level", "tag", "pid", "tid", "message"]


def records(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["device"], []).append([r[c] for c in FIELDS])
    return {d: sorted(rows) for d, rows in out.items()}


def want(feeds=FEEDS):
    return {d: sequential.ingest(feed, "com.a").records for d, feed in feeds.items()}


def test_chained_batches_equal_one(spark, lines_frame, tmp_path):
    out = str(tmp_path / "out")
    cuts = [0, 31, 32, 90, 91, 200]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # One device is silent in the second batch.
        part = {d: feed[a:b] for d, feed in FEEDS.items() if not (batch == 1 and d == "d2")}
        if batch == 2:
            part["d2"] = FEEDS["d2"][31:b]
        ingest_batch(lines_frame(part), out, batch, "com.a", bits=4)
    assert records(stored_logs(spark, out)) == want()


def test_rerun_of_a_batch_changes_nothing(spark, lines_frame, tmp_path):
    out = str(tmp_path / "out")
    halves = [{d: feed[:100] for d, feed in FEEDS.items()}, {d: feed[100:] for d, feed in FEEDS.items()}]
    for batch, part in ((0, halves[0]), (1, halves[1]), (1, halves[1])):
        ingest_batch(lines_frame(part), out, batch, "com.a")
    assert records(stored_logs(spark, out)) == want()


def test_clear_keeps_counters(spark, lines_frame, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    ingest_batch(lines_frame(FEEDS), old, 0, "com.a")
    clear(spark, old, 0, new)
    ingest_batch(lines_frame({"d0": FEEDS["d0"]}), new, 0, "com.a")
    before, after = want()["d0"], records(stored_logs(spark, new))["d0"]
    assert [r[0] for r in after] == [len(before) + r[0] for r in before]
    assert [r[1] for r in after] == [before[-1][1] + r[1] for r in before]
    assert [r[2:] for r in after] == [r[2:] for r in before]


def test_stream_stops_and_resumes(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    cuts = [0, 50, 51, 140, 200]
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for d, feed in FEEDS.items():
            (folder / f"device={d}").mkdir(parents=True, exist_ok=True)
            (folder / f"device={d}" / f"log.{step}.txt").write_text("".join(v + "\n" for _, v in feed[a:b]))
        query = start_ingest(stream_lines(spark, str(folder)), out, str(tmp_path / "checkpoint"), "com.a", bits=5, availableNow=True)
        query.awaitTermination()
    assert records(stored_logs(spark, out)) == want()

    compact(spark, out, str(tmp_path / "kept"), RetentionPolicy(40, 3))
    kept = read_logs(spark, str(tmp_path / "kept"))
    for d, rows in want().items():
        sessions = sorted({r[1] for r in rows})[-3:]
        assert records(kept)[d] == [r for r in rows if r[1] in sessions][-40:]
