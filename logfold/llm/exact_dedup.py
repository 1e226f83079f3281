"""Exact duplicates by sorting contents.

Splitters that Spark samples cut the order of the texts into ranges, the external sort of each range
puts equal texts side by side, and the window over the sorted rows compares every text in full with its
neighbour. Of equal texts the row with the largest id stays. The order is that of the first LEAD
characters, then of a hash, then of the whole text: what is sampled has a fixed size, and many texts
that begin alike still spread over ranges.

A text with more copies than a range should hold is cut into slices, so that its copies spread
over ranges; its size and largest id come from sums that are built before any shuffle.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.common import beside, hot_groups, lower_ascii, partitions, text_of

LEAD = 32
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; texts are equal up to the case of A-Z.

    A null text equals an empty one. Null ids come last: they stay only if their group has no other.
    Of repeated rows with one id, one stays. An empty table gives no rows. ``carry`` names the
    columns to keep (all by default); a column with the name of a result is replaced.
    """
    given = docs.columns if carry is None else carry
    norm = lower_ascii(text_of(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.col(id).alias("_id"), norm.alias("_norm"))
    rows = rows.withColumn("text_sha256", F.sha2("_norm", 256))
    keys = docs.select(F.sha2(norm, 256).alias("text_sha256"), F.col(id).alias("_id"))
    hot = hot_groups(keys, "text_sha256", F.max("_id").alias("_max"))

    slices = partitions(docs.sparkSession)
    rows = rows.join(F.broadcast(hot), "text_sha256", "left").withColumn(
        "_slice", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int"))
    )
    rows = rows.withColumns({"_lead": F.substring("_norm", 1, LEAD), "_hash": F.xxhash64("_norm")})
    ranges = rows.repartitionByRange("_lead", "_hash", "_slice")
    equal = Window.partitionBy("_lead", "_hash", "_slice", "_norm")
    newest = equal.orderBy(F.desc("_id"))
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranges.select(
        "row", "_id", "text_sha256", "_n", "_max",
        F.row_number().over(newest).alias("_rank"),
        F.first("_id").over(whole).alias("_first"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    )
    keep = F.when(F.col("_n").isNull(), F.col("_first")).otherwise(F.col("_max"))
    found = found.withColumns({
        "keep_id": keep,
        "group_size": F.coalesce("_n", "_size"),
        "kept": (F.col("_rank") == 1) & F.col("_id").eqNullSafe(keep),
    })
    return beside(found, "row", given, RESULTS)
