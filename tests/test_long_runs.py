"""Runs and records that reach over very many buckets."""

from pyspark.sql import functions as F

from logfold.operators.fold import fold_runs
from logfold.operators.ingest import _runs, ingest
from logfold.plans.scan import BUCKET, gather_tails


def test_buckets_of_a_long_run_are_dealt_out(spark):
    """10,000 buckets of one run: their numbers are added up, and no task gets more than its share."""
    later = F.col("id") > 0
    seams = spark.range(10_000).select(
        F.lit("d").alias("device"), F.col("id").alias(BUCKET), later.alias("joined"), later.alias("crossing"),
        F.lit(1).cast("bigint").alias("runs"), later.cast("bigint").alias("before_runs"), F.lit(2).cast("bigint").alias("size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = gather_tails(seams, ["device"], [], F.struct(BUCKET, "size"), {
            "more": lambda parts: F.sum(parts["size"]), "end": lambda parts: F.max(parts[BUCKET])})
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        rows = {r[BUCKET]: (r["more"], r["end"]) for r in found.filter("more is not null").collect()}
        assert found.count() == 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows == {0: (2 * 9_999, 9_999)}
    assert max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]


def test_fold_of_a_long_run(spark):
    """Short runs, one over hundreds of buckets, short runs again."""
    df = spark.range(3_000).selectExpr("id", "case when id between 500 and 2499 then 'long' else cast(id div 3 as string) end v")
    runs = sorted((r["first_id"], r["last_id"], r["count"]) for r in fold_runs(df, [], "id", ["v"], bits=2).collect())
    assert (500, 2499, 2000) in runs
    assert sum(r[2] for r in runs) == 3_000 and all(b - a + 1 == n for a, b, n in runs)


def _lines(spark):
    """A record of 400 lines between records of one."""
    text = F.concat(
        F.lit("05-01 10:00:00."), F.lpad(F.when(F.col("id") < 50, F.col("id")).when(F.col("id") < 450, 50).otherwise(F.col("id") - 399).cast("string"), 3, "0"),
        F.lit("  1  2 I T : m"), F.col("id").cast("string"))
    return spark.range(500).select(F.lit("d").alias("device"), F.col("id").alias("seq"), text.alias("value"))


def test_text_of_a_long_record(spark):
    rows = ingest(_lines(spark), bits=2).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 102))
    assert [r["message"].split("\n") for r in rows] == (
        [[f"m{i}"] for i in range(50)] + [[f"m{i}" for i in range(50, 450)]] + [[f"m{i}"] for i in range(450, 500)])


def test_no_text_where_buckets_are_chained(spark):
    """What goes through the windows over buckets holds keys and numbers alone."""
    _, seams = _runs(_lines(spark), None, None, None, 2)
    kinds = seams.schema.simpleString()
    assert "msg" not in kinds and "opening" not in kinds and "array" not in kinds
