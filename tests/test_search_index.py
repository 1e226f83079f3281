"""Searches that skip blocks of ids."""

import pytest
from pyspark.sql import functions as F

from logfold.operators.lookup import search_logs
from logfold.sources.logs import read_logs, write_logs
from logfold.sources.search_index import grams_of, indexed_upto, read_search_index, search_index, skip_blocks, write_search_index


def row(id, message, device="d"):
    return (device, id, 0, "05-01 10:00:00.000", "I", "T", 1, 1, message)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """20,000 records of one device, a rare word in two places, and a second device with the word."""
    path = str(tmp_path_factory.mktemp("search"))
    from logfold.schema import LOGS
    special = {7: "Needle one", 15_000: "a NEEDLE_two\nsecond line", 15_001: "50% of ÉTÉ", 15_002: "", 9_000: "xy"}
    rows = [row(i, special.get(i, f"common text {i % 7}")) for i in range(1, 20_001)] + [row(3, "needle elsewhere", "e")]
    names = ["device", "id", "session_id", "timestamp", "level", "tag", "pid", "tid", "message"]
    df = spark.createDataFrame(rows, "device string, id long, session_id long, timestamp string, level string, tag string, pid long, tid long, message string")
    assert df.columns == names
    write_logs(df.select(LOGS.fieldNames()), f"{path}/logs")
    logs = read_logs(spark, f"{path}/logs")
    write_search_index(logs, f"{path}/index")
    return logs, read_search_index(spark, f"{path}/index")


QUERIES = ["needle", "Needle", "NEEDLE%two", "needle_two", "common TEXT 3", "xy", "", "%", "50%", "ÉT", "ÉTÉ", "Été", "éTé", "second line", "no such text",
           "dle\\", "needle%absent", "two\nsec"]


@pytest.mark.parametrize("fold", [False, True])
def test_results_do_not_depend_on_the_index(stored, fold):
    logs, index = stored
    for query in QUERIES:
        for limit in (3, 100):
            got = search_logs(logs, "d", query, limit, fold, index).collect()
            assert got == search_logs(logs, "d", query, limit, fold).collect(), query


def test_a_rare_word_skips_blocks(stored):
    logs, index = stored
    left = skip_blocks(logs, index, "d", "Needle")
    assert {r["b"] for r in left.select((F.col("id") / 4096).cast("int").alias("b")).distinct().collect()} == {0, 3, 4}
    # Of block 4 only the newest indexed record is read, to which text may have been appended.
    assert left.count() == 4095 + 4096 + 1
    assert "LessThanOrEqual(id,4095)" in left._jdf.queryExecution().executedPlan().toString()
    assert skip_blocks(logs, index, "d", "absent word").count() == 1
    # Too short a text says nothing about blocks.
    assert skip_blocks(logs, index, "d", "xy").count() == 20_000


def test_many_blocks_are_read_as_without_an_index(stored, monkeypatch):
    logs, index = stored
    monkeypatch.setattr("logfold.sources.search_index.MAX_RANGES", 1)
    assert skip_blocks(logs, index, "d", "needle").count() == 20_000


def test_records_beyond_the_index_are_searched(spark, logs_frame, tmp_path):
    """An index of the first records, then more records and more text for the newest indexed one, then the index goes on."""
    path = str(tmp_path / "index")
    write_search_index(logs_frame([row(i, "plain") for i in range(1, 10)]), path, bits=1)
    logs = logs_frame([row(i, "plain") for i in range(1, 9)] + [row(9, "plain\nneedle")] + [row(i, f"needle {i}") for i in range(10, 14)])
    for _ in range(2):
        index = read_search_index(spark, path)
        assert [r["id"] for r in search_logs(logs, "d", "needle", 25, index=index).collect()] == [13, 12, 11, 10, 9]
        write_search_index(logs.filter(F.col("id") >= indexed_upto(index, "d")), path, bits=1)
    assert indexed_upto(read_search_index(spark, path), "d") == 13


def test_odd_records(logs_frame):
    """Null and short messages have no grams; an empty table has no index and nothing is skipped."""
    index = search_index(logs_frame([row(1, None), row(2, "ab"), row(3, "abca")]))
    assert sorted((r["gram"], r["upto"]) for r in index.collect()) == [("", 3), ("abc", 3), ("bca", 3)]
    none = logs_frame([row(1, "abc")]).limit(0)
    assert search_index(none).count() == 0
    assert search_logs(logs_frame([row(1, "abc")]), "d", "abc", index=search_index(none)).count() == 1
    assert grams_of("aB%CDef_gh") == ["cde", "def"]
