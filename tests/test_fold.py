import random

import pytest

from tests import sequential
from logfold.operators.fold import SAME, fold_entries, fold_logs, fold_runs


def rows_of(seed, n, device="d"):
    rng = random.Random(seed)
    out, now = [], ("I", "T", "m", 1)
    for i in range(1, n + 1):
        if rng.random() < 0.3:
            now = (rng.choice("IE"), "T", rng.choice("mno"), rng.randint(1, 2))
        if rng.random() < 0.9:
            out.append((device, i, rng.randint(0, 1), f"ts{i:05d}", now[0], now[1], now[3], rng.randint(1, 9), now[2]))
    return out


def wanted(rows):
    named = [dict(zip(["device", "id", "session_id", "timestamp", "level", "tag", "pid", "tid", "message"], r)) for r in rows]
    return [(a["id"], b["id"], a["timestamp"], b["timestamp"], a["level"], a["message"], a["pid"], n)
            for a, b, n in sequential.fold(named, SAME)]


def got(df):
    return sorted((r["start_id"], r["end_id"], r["start_time"], r["end_time"], r["level"], r["message"], r["pid"], r["count"])
                  for r in df.collect())


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_whole_history(logs_frame, bits):
    a, b = rows_of(1, 400, "a"), rows_of(2, 300, "b")
    assert got(fold_logs(logs_frame(a + b), bits)) == sorted(wanted(a) + wanted(b))


def test_one_run_everywhere(logs_frame):
    rows = [("d", i, 0, f"t{i:03d}", "I", "T", 1, i, "m") for i in range(1, 101)]
    assert got(fold_logs(logs_frame(rows), 2)) == [(1, 100, "t001", "t100", "I", "m", 1, 100)]


def test_fold_table(logs_frame):
    rows = [("d", i, 0, f"TS{i}", "I", "T", 1, 0, "M") for i in (3, 2, 1)] + [("d", 0, 0, "TS0", "D", "T", 1, 0, "D")]
    first, second = fold_entries(logs_frame(rows), 10).collect()
    assert (first["count"], first["start_id"], first["end_id"]) == (3, 1, 3)
    assert second["count"] == 1


def test_limit_keeps_whole_runs(logs_frame):
    rows = rows_of(5, 200)
    for limit in (0, 1, 7):
        want = wanted(rows)[-limit:] if limit else []
        assert got(fold_entries(logs_frame(rows), limit)) == want


def test_null_keys_and_values(spark):
    rows = [(None, 1, "a"), (None, 2, "a"), (None, 3, None), (None, 9, None), (1, 1, "a")]
    df = spark.createDataFrame(rows, "k int, n bigint, v string")
    out = sorted((str(r["k"]), r["first_n"], r["last_n"], str(r["v"]), r["count"])
                 for r in fold_runs(df, ["k"], "n", ["v"], bits=1).collect())
    assert out == [("1", 1, 1, "a", 1), ("None", 1, 2, "a", 2), ("None", 3, 9, "None", 2)]


def test_no_keys(spark):
    df = spark.range(100).selectExpr("id", "id div 10 as v")
    assert fold_runs(df, [], "id", ["v"], bits=2).count() == 10


def test_one_scan_and_one_wide_shuffle(spark, logs_frame, tmp_path):
    logs_frame(rows_of(1, 50)).write.parquet(str(tmp_path / "logs"))
    plan = fold_logs(spark.read.parquet(str(tmp_path / "logs")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
