"""Helpers shared by the operators: tables, folders, results next to given columns, groups that are too large for one task."""

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space between words, as a class of Java and Python regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
# A group is hot when it holds more than 1 / (HOT_SHARE * partitions) of the rows;
# so there are fewer than HOT_SHARE * partitions hot groups, whatever the input.
HOT_SHARE = 4

BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of BATCH_ROWS rows and BATCH_BYTES, unless the session has its own numbers."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now == usual or (usual is None and now is not None and int(str(now).rstrip("bB")) > BATCH_BYTES):
            spark.conf.set(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting, a session that runs in one process gets a temporary folder; any other is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost no rework."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def forget(*frames: DataFrame) -> None:
    """Delete the folders of frames from `stored` that no frame in use reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast way, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pinned(column: Column) -> Column:
    """The same value, behind an expression that filters are not moved through.

    A filter on the result of a long chain of steps would else be copied into each of them.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def beside(df: DataFrame, row: str, given: list[str], results: list[str]) -> DataFrame:
    """The fields of struct ``row`` and the results; a given column with the name of a result gives way."""
    taken = {c.lower() for c in results}
    kept = [F.col(row).getField(c).alias(c) for c in given if c.lower() not in taken]
    return df.select(*kept, *results)


def hot_groups(rows: DataFrame, key: str, *values: Column) -> DataFrame:
    """The hot groups of ``key`` with their size ``_n`` and ``values``: few enough to broadcast, see HOT_SHARE.

    Counted with partial sums before the shuffle, over all rows.
    """
    limit = HOT_SHARE * partitions(rows.sparkSession)
    total = rows.agg(F.count(F.lit(1))).scalar()
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *values)
    return sizes.filter((F.col("_n") > 1) & (F.col("_n") * limit > total))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, by: str, how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """Join one row per group to the rows of the group; ``groups`` has ``_n``, how many rows will meet it.

    A hot group is copied once for every task's share of its rows, fewer than HOT_SHARE * partitions
    copies in all, and its rows choose a copy by ``by``. Only the keys of hot groups are broadcast.
    ``sizes`` (key, _n) spares computing ``groups`` again to find them.
    """
    limit = HOT_SHARE * partitions(rows.sparkSession)
    sizes = groups if sizes is None else sizes
    total = sizes.agg(F.sum("_n")).scalar()
    number = F.ceil(F.col("_n") * limit / F.greatest(total, F.lit(1))).cast("int")
    copies = groups.withColumn("_copies", number)
    hot = sizes.withColumn("_copies", number).filter("_copies > 1").select(F.col(key).alias("_hot"), F.col("_copies").alias("_of"))
    spread = F.xxhash64(by)
    # Rows without a key meet nothing; they are dealt out as well.
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(spread, F.lit(limit))).otherwise(F.pmod(spread, F.coalesce("_of", F.lit(1))))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt.cast("int")).drop("_hot", "_of")
    each = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(each, [key, "_salt"], how).drop("_salt")
