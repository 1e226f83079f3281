"""Queries, retention and reports over stored records."""

import random
from itertools import groupby

import pytest

from logfold.operators import report
from logfold.operators.lookup import contexts, log_context, log_count, query_logs, search_logs
from logfold.operators.retention import RetentionPolicy, apply_retention, keep_rows, keep_sessions
from logfold.operators.summaries import error_summary, error_summary_all, last_timestamp, session_count, sessions, status, tag_summary
from logfold.sources.logs import read_logs, write_logs
from pyspark.sql import functions as F


def row(id, session=0, level="I", tag="T", pid=1, message="m", ts=None, device="d"):
    return (device, id, session, ts or f"05-01 10:00:{id % 60:02d}.000", level, tag, pid, 1, message)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def logs(logs_frame):
    rng = random.Random(3)
    rows = [row(i, i // 20, rng.choice("VDIWEF"), rng.choice(["Net", "net_x", "UI"]), rng.randint(1, 2), rng.choice(["Boom", "ok 50%", "a\nb"]))
            for i in range(1, 101) if i % 7]
    return logs_frame(rows + [row(1, 9, "E", device="other")]).cache()


def test_filters_and_limits(logs):
    assert ids(query_logs(logs, "d", limit=3)) == [100]
    assert ids(query_logs(logs, "d", 4, limit=3)) == [99, 97, 96]
    assert ids(query_logs(logs, "d", 4, limit=0)) == []
    assert len(ids(query_logs(logs, "d", 4, limit=-1))) == logs.filter("device = 'd' and session_id = 4").count()
    want = [r["id"] for r in logs.orderBy(F.desc("id")).collect() if r["device"] == "d" and r["session_id"] == 4 and r["level"] == "E" and "net" in r["tag"].lower()]
    assert ids(query_logs(logs, "d", 4, "E", "NET", limit=50)) == want
    assert query_logs(logs, "d", 4, level="e").count() == 0
    assert query_logs(logs, "d", 4, limit=-1, fold=True).count() == 0
    assert query_logs(logs, "d", 4, limit=0, fold=True).count() == 0


def test_search_in_all_sessions(logs):
    want = [r["id"] for r in logs.orderBy(F.desc("id")).collect() if r["device"] == "d" and r["message"] == "Boom"]
    assert ids(search_logs(logs, "d", "bOOm", -1)) == want
    assert search_logs(logs, "d", "", -1).count() == logs.filter("device = 'd'").count()
    assert search_logs(logs, "d", "50%", -1).filter("message <> 'ok 50%'").count() == 0


def test_folding_reads_all_rows_of_a_long_run(logs_frame):
    frame = logs_frame([row(i) for i in range(1, 2001)])
    [run] = query_logs(frame, "d", 0, limit=2, fold=True).collect()
    assert (run["start_id"], run["end_id"], run["count"]) == (1, 2000, 2000)
    [run] = search_logs(frame, "d", "M", limit=500, fold=True).collect()
    assert run["count"] == 2000


@pytest.mark.parametrize("limit", [1, 3, 7, 40])
def test_newest_runs_by_ranges_of_ids(logs_frame, monkeypatch, limit):
    """Ranges grow until they hold one run more than asked for; long runs and rare records make them grow to all ids."""
    rng = random.Random(limit)
    messages = [m for m in ("a", "b", "a", "c", "rare") for _ in range(rng.choice([1, 2, 30, 90]))]
    frame = logs_frame([row(10 + i, message=m) for i, m in enumerate(messages)]).cache()
    for name, value in (("FIRST_SPAN", 4), ("SPAN_PER_RUN", 1), ("ONE_WINDOW", 64)):
        monkeypatch.setattr(f"logfold.operators.lookup.{name}", value)
    for query in ("", "a", "rare"):
        found = [10 + i for i, m in enumerate(messages) if query in m]
        runs = []
        for i in found:
            if runs and messages[i - 10] == messages[runs[-1][1] - 10]:
                runs[-1] = (runs[-1][0], i, runs[-1][2] + 1)
            else:
                runs.append((i, i, 1))
        got = [(r["start_id"], r["end_id"], r["count"]) for r in search_logs(frame, "d", query, limit, fold=True).collect()]
        assert got == runs[::-1][:limit]


def test_folded_query_reads_the_newest_ids_only(logs_frame, spark, tmp_path):
    write_logs(logs_frame([row(i, message=str(i)) for i in range(1, 20_001)]), str(tmp_path / "many"))
    found = query_logs(read_logs(spark, str(tmp_path / "many")), "d", 0, limit=5, fold=True)
    assert [r["end_id"] for r in found.collect()] == [20_000, 19_999, 19_998, 19_997, 19_996]
    assert "GreaterThan(id,15904)" in found._jdf.queryExecution().executedPlan().toString()


def test_contexts_of_few_anchors_leave_records_in_place(logs):
    anchors = logs.filter("level = 'E'").select("device", "id")
    assert "BroadcastHashJoin" in contexts(logs, anchors, 3)._jdf.queryExecution().executedPlan().toString()
    assert sorted(contexts(logs, anchors, 3, small=False).collect()) == sorted(contexts(logs, anchors, 3).collect())


def test_pages_are_bounded(logs):
    for limit in (-1, report.PAGE_ROWS + 1):
        with pytest.raises(ValueError):
            report.search_report(logs, "d", "Boom", limit)


def test_search_folds_across_sessions(logs_frame):
    [run] = search_logs(logs_frame([row(1, 0), row(2, 1), row(3, 1)]), "d", "m", fold=True).collect()
    assert (run["start_id"], run["end_id"], run["count"]) == (1, 3, 3)


def test_context_is_id_arithmetic(logs):
    assert ids(log_context(logs, "d", 50, 3)) == [47, 48, 50, 51, 52, 53]
    assert ids(log_context(logs, "d", 49, 1)) == [48, 50]
    assert ids(log_context(logs, "d", 2, 5)) == [1, 2, 3, 4, 5, 6]
    assert ids(log_context(logs, "d", 50, -1)) == []


@pytest.mark.parametrize("n", [0, 1, 4, 40])
def test_contexts_of_many_anchors(logs, n):
    anchors = logs.filter("level = 'E'").select("device", "id")
    got = sorted((r["device"], r["center_id"], r["id"], r["is_center"]) for r in contexts(logs, anchors, n).collect())
    have = [(r["device"], r["id"]) for r in logs.collect()]
    want = sorted((d, a["id"], i, i == a["id"]) for a in anchors.collect() for d, i in have
                  if d == a["device"] and max(1, a["id"] - n) <= i <= a["id"] + n)
    assert got == want


def test_summaries(logs):
    rows = [r for r in logs.collect() if r["device"] == "d" and r["session_id"] == 2]
    groups = {}
    for r in rows:
        if r["level"] in "EF":
            groups.setdefault((r["tag"], r["message"]), []).append(r["id"])
    want = sorted(((-len(v), k[0], k[1], max(v)) for k, v in groups.items()))
    got = [(-r["count"], r["tag"], r["message"], r["last_id"]) for r in error_summary(logs, "d", 2).collect()]
    assert got == want
    every = error_summary_all(logs).filter("device = 'd' and session_id = 2").orderBy("rank").collect()
    assert [(-r["count"], r["tag"], r["message"], r["last_id"]) for r in every] == want
    assert {r["tag"]: r["count"] for r in tag_summary(logs, "d", 2).collect()} == {
        t: sum(r["tag"] == t for r in rows) for t in {r["tag"] for r in rows}}
    [one] = sessions(logs).filter("device = 'd' and session_id = 2").collect()
    assert (one["first_id"], one["last_id"], one["rows"]) == (min(r["id"] for r in rows), max(r["id"] for r in rows), len(rows))
    assert log_count(logs, "d", 2).first()["count"] == len(rows)
    assert {r["device"]: r["sessions"] for r in session_count(logs).collect()} == {"d": 6, "other": 1}


def test_top_k_is_cut_before_the_shuffle(logs):
    plan = error_summary_all(logs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_last_timestamp_is_of_the_newest_id(logs_frame):
    frame = logs_frame([row(1, ts="z"), row(2, ts="a")])
    assert last_timestamp(frame).first()["last_ts"] == "a"


def test_keep_sessions_table(logs_frame):
    frame = logs_frame([row(s, s) for s in range(1, 6)])
    kept = apply_retention(frame, RetentionPolicy(100, 2))
    assert {r["session_id"] for r in kept.collect()} == {4, 5}
    more = kept.unionByName(logs_frame([row(i, 6) for i in range(10, 20)]))
    assert apply_retention(more, RetentionPolicy(5, 10)).count() == 5


@pytest.mark.parametrize("limits", [(5, 2), (0, 2), (5, 0), (-1, -1), (1000, 1000), (1, 1), (37, 4)])
@pytest.mark.parametrize("bits", [2, 16])
def test_retention(logs, limits, bits):
    max_logs, max_sessions = limits
    want = []
    for device in ("d", "other"):
        rows = [r for r in logs.collect() if r["device"] == device]
        if max_sessions > 0:
            keep = sorted({r["session_id"] for r in rows})[-max_sessions:]
            rows = [r for r in rows if r["session_id"] in keep]
        if max_logs > 0:
            rows = sorted(rows, key=lambda r: r["id"])[-max_logs:]
        want += [(device, r["id"]) for r in rows]
    got = keep_rows(keep_sessions(logs, max_sessions), max_logs, bits=bits)
    assert sorted((r["device"], r["id"]) for r in got.collect()) == sorted(want)


def test_retention_without_broadcast(logs):
    kept = keep_rows(keep_sessions(logs, 3, small=False), 10, small=False)
    assert kept.count() == 11


def test_policy_minimums():
    assert "500" in report.policy_report(RetentionPolicy(500, 5, 60))
    for bad in (RetentionPolicy(10), RetentionPolicy(500, 0), RetentionPolicy(500, 1, 4)):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(ValueError):
        report.target_report("")
    assert report.target_report("com.test.app") == "Now tracking sessions for: com.test.app"


def text(df):
    return df.first()["text"]


def test_reports(logs_frame):
    frame = logs_frame([row(1, level="E", tag="Test", message="link lost"), row(2, tag="Test", message="link is back")])
    assert text(report.error_report(frame, "d")) == "### Error Summary (Current Session)\n- [1] **1x** [Test] link lost\n"
    assert text(report.tag_report(frame, "d")) == "### Tag Summary (Current Session)\n- **2** Test\n"
    found = text(report.query_report(frame, "d", level="E"))
    assert "link lost" in found and "link is back" not in found
    searched = text(report.search_report(frame, "d", "BACK"))
    assert searched.startswith("### Test (1)\n- [2] **I** 10:00:02.000 link is back\n") and not searched.endswith("query if needed.*")
    assert text(report.context_report(frame, "d", 1, 5)).splitlines() == [
        "### Test (1)", "#### link lost", "> - [1] **E** 10:00:01.000", "#### link is back", "- [2] **I** 10:00:02.000"]
    shown = text(report.status_report(frame, "d", "com.example.app"))
    assert "com.example.app" in shown and "**Current Session Logs**: 2 rows" in shown
    with pytest.raises(ValueError):
        report.context_report(frame, "d", 0)


def test_reports_of_nothing(logs_frame):
    none = logs_frame([])
    assert text(report.error_report(none, "d")) == report.NO_ERRORS
    assert text(report.tag_report(none, "d")) == report.NO_TAGS
    assert text(report.query_report(none, "d")) == report.NO_LOGS
    assert text(report.search_report(none, "d", "x", fold=False)) == report.NO_MATCH
    assert text(report.context_report(none, "d", 5)) == report.NO_CONTEXT
    state = status(none, "d").first()
    assert (state["session_id"], state["session_rows"], state["target_package"]) == (0, 0, "None (System-wide)")


def rendered(rows, center=None):
    """Neighbours of one source share a heading, and among these neighbours with one first line a sub-heading."""
    entry = lambda r: f"{'> ' if r['id'] == center else ''}- [{r['id']}] **{r['level']}** {r['timestamp'][6:]}\n" + "".join(
        f"  {line}\n" for _, sep, rest in [r["message"].partition("\n")] if rest for line in rest.split("\n"))
    out = []
    for source, same in groupby(rows, key=lambda r: (r["tag"], r["pid"])):
        out.append("### {} ({})\n".format(*source))
        for k, (head, few) in enumerate(groupby(same, key=lambda r: r["message"].split("\n")[0])):
            # Nothing is shown for an empty first line right below the heading.
            out += [f"#### {head}\n" * bool(head or k), *map(entry, few)]
    return "".join(out)


@pytest.mark.parametrize("limited", [True, False])
def test_render_entries(logs_frame, limited):
    rng = random.Random(1)
    rows = [row(i, pid=rng.randint(1, 2), message=rng.choice(["", "a", "a\nb", "\nc", "a\n\nd"])) for i in range(1, 120)]
    frame = logs_frame(rows)
    got = report.render_entries(frame, "id", F.lit(50), limited=limited, bits=2).orderBy("id").collect()
    assert "".join(r["text"] for r in got) == rendered(frame.orderBy("id").collect(), 50)


@pytest.mark.parametrize("limited", [True, False])
def test_render_folded(spark, limited):
    runs = spark.createDataFrame(
        [("d", 1, 5, "05-01 10:00:00.000", "05-01 10:00:05.000", "I", "Radio", 81, "scan", 5),
         ("d", 6, 6, "05-01 10:00:06.000", "05-01 10:00:06.000", "W", "Radio", 81, "stop\nx", 1)],
        "device string, start_id long, end_id long, start_time string, end_time string, level string, tag string, pid long, message string, count long")
    got = report.render_folded(runs, "end_id", limited, bits=1).orderBy("end_id").collect()
    assert "".join(r["text"] for r in got) == ("### Radio (81)\n- [1-5] **I** 10:00:00.000 - 10:00:05.000 scan (5x)\n"
                                               "- [6] **W** 10:00:06.000 stop\n")


def test_store_pushes_filters_down(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    write_logs(logs, path)
    stored = read_logs(spark, path)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, logs.collect()))
    plan = log_context(stored, "d", 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(device" in plan and "GreaterThanOrEqual(id,35)" in plan
