import pytest

from tests import sequential
from logfold.operators.ingest import RESTART_TAGS, RESTART_WORDS, accept_lines, drop_late, ingest, is_restart, sessionize
from pyspark.sql import functions as F

FEEDS = {f"d{i}": sequential.feed(i, 260, gap=1 + i % 3) for i in range(4)}
FIELDS = ["id", "session_id", "timestamp", "level", "tag", "pid", "tid", "message"]


def records(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["device"], []).append([r[c] for c in FIELDS])
    return {d: sorted(rows) for d, rows in out.items()}


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_ingest_equals_line_by_line(lines_frame, bits):
    got = records(ingest(lines_frame(FEEDS), "com.a", bits=bits))
    want = {d: sequential.ingest(feed, "com.a").records for d, feed in FEEDS.items()}
    assert got == want
    assert any("\n" in r[-1] for r in want["d0"])


def test_sparse_positions_and_no_package(lines_frame):
    feeds = {"a": [(s * (1 << 40) + 7, v) for s, v in sequential.feed(9, 120)]}
    got = records(ingest(lines_frame(feeds), None))
    assert got == {"a": sequential.ingest(feeds["a"], None).records}
    assert {r[1] for r in got["a"]} == {0}


@pytest.mark.parametrize("bits", [3, 16])
def test_target_changes(spark, lines_frame, bits):
    changes = {"d0": [(40, "com.b"), (150, ""), (200, "com.a")], "d1": [(1, "com.b")]}
    frame = spark.createDataFrame([(d, s, p) for d, cs in changes.items() for s, p in cs],
                                  "device string, from_seq bigint, package string")
    got = records(ingest(lines_frame(FEEDS), "com.a", targets=frame, bits=bits))
    want = {d: sequential.ingest(feed, "com.a", changes.get(d, [])).records for d, feed in FEEDS.items()}
    assert got == want


def test_sessionize_keeps_lines(lines_frame):
    rows = sessionize(lines_frame(FEEDS), "com.a", bits=4).collect()
    for d, feed in FEEDS.items():
        got = sorted((r["seq"], r["id"], r["session_id"]) for r in rows if r["device"] == d)
        assert got == sequential.ingest(feed, "com.a").lines


def test_accept_and_late(lines_frame):
    accepted = accept_lines(lines_frame(FEEDS), bits=3)
    timely = drop_late(lines_frame(FEEDS), bits=3)
    for d, feed in FEEDS.items():
        want = [s for s, _, _ in sequential.ingest(feed, "").lines]
        assert sorted(r["seq"] for r in accepted.filter(F.col("device") == d).collect()) == want
        newest, kept = "", []
        for s, v in feed:
            fields = sequential.parse(v)
            if fields and fields[0] >= newest:
                newest, _ = fields[0], kept.append(s)
        assert sorted(r["seq"] for r in timely.filter(F.col("device") == d).collect()) == kept


def test_one_run_over_every_bucket(lines_frame):
    lines = [(i, f"05-01 10:00:00.000  1  1 E T: m{i}") for i in range(50)]
    [row] = ingest(lines_frame({"d": lines}), None, bits=2).collect()
    assert row["message"] == "\n".join(f"m{i}" for i in range(50))


def test_what_is_taken(lines_frame):
    """In order: taken, no log line, taken with numbers out of range, late as a copy of the first, late by a day."""
    huge = "7" * 25
    feed = ["03-17 22:41:09.100  81  92 W Radio : link up", "--------- beginning of a buffer", f"03-17 22:41:09.200  {huge}  {huge} V Big : n",
            "03-17 22:41:09.100  81  92 W Radio : link up", "03-16 22:41:09.300  81  92 W Radio : yesterday"]
    rows = accept_lines(lines_frame({"d": list(enumerate(feed))})).orderBy("seq").collect()
    assert [(r["seq"], r["pid"], r["tid"], r["tag"]) for r in rows] == [(0, 81, 92, "Radio"), (2, 0, 0, "Big")]


def test_only_whole_lines_are_duplicates(lines_frame):
    """Lines that differ in any one part from those before are taken, copies of any of them are not."""
    parts = ("03-17 22:41:09.100", "81", "92", "W", "Radio", "up")
    other = ("03-17 22:41:09.200", "82", "93", "E", "Radi", "up ")
    lines = ["{}  {}  {} {} {} : {}".format(*parts)]
    lines += ["{}  {}  {} {} {} : {}".format(*parts[:k], other[k], *parts[k + 1:]) for k in (1, 2, 3, 4, 5, 0)]
    feed = list(enumerate([*lines[:6], *lines[:6], lines[6], lines[6]]))
    assert sorted(r["seq"] for r in accept_lines(lines_frame({"d": feed})).collect()) == [0, 1, 2, 3, 4, 5, 12]


@pytest.mark.parametrize("tag", RESTART_TAGS)
@pytest.mark.parametrize("word", RESTART_WORDS)
def test_a_restart_as_first_line_opens_session_one(lines_frame, tag, word):
    [row] = ingest(lines_frame({"d": [(1, f"03-17 22:41:09.100  9  9 D {tag} : {word} org.sample/u0")]}), "org.sample").collect()
    assert (row["session_id"], row["id"]) == (1, 1)


def test_restart_is_case_sensitive(spark):
    rows = spark.createDataFrame([("ActivityManager", "start proc com.a"), ("activitymanager", "Start proc com.a"),
                                  ("ActivityTaskManager", "Killing 1:com.a/u0")], "tag string, msg string")
    got = [r[0] for r in rows.select(is_restart(F.col("tag"), F.col("msg"), F.lit("com.a"))).collect()]
    assert got == [False, False, True]


def test_many_sources_take_turns(lines_frame):
    """A record per line, in order, as no two neighbours have one source."""
    feed = [(k, f"03-17 {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}.000  {k % 7}  1 V Src{k % 7} : n{k}") for k in range(9000)]
    logs = ingest(lines_frame({"d": feed}), None)
    rows = logs.orderBy("id").collect()
    assert [(r["id"], r["session_id"], r["message"]) for r in rows] == [(k + 1, 0, f"n{k}") for k in range(9000)]


def test_one_scan_and_two_wide_shuffles(spark, lines_frame, tmp_path):
    """Every branch of the plan reads the same spread rows."""
    lines_frame(FEEDS).write.parquet(str(tmp_path / "lines"))
    plan = ingest(spark.read.parquet(str(tmp_path / "lines")), "com.a")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1
    assert text.count("REPARTITION_BY_COL") - text.count("ReusedExchange") <= 1
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
