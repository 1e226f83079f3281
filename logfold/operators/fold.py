"""Folding: runs of identical neighbours become one row with a count."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logfold.plans.scan import BITS, BUCKET, attach, gather_tails, in_bucket, spread, stitch

# Records fold when they agree on these; thread, time and session may differ.
SAME = ["level", "tag", "pid", "message"]


def _runs(rows: DataFrame, window: WindowSpec, position: str, same: list[str], ends: list[str]) -> DataFrame:
    """One row per run inside the window partition: its first row plus ``_end`` and ``_size``.

    Only rows at the edges of a run are looked at twice, and everything follows
    one sort order, so nothing is aggregated or sorted again.
    """
    rows = rows.withColumn("_same", F.struct(*same))
    rows = rows.withColumns({
        "_n": F.row_number().over(window),
        "_prev": F.lag("_same").over(window),
        "_next": F.lead("_same").over(window),
    })
    rows = rows.withColumns({
        "_opens": F.col("_prev").isNull() | (F.col("_prev") != F.col("_same")),
        "_closes": F.col("_next").isNull() | (F.col("_next") != F.col("_same")),
    }).filter("_opens or _closes")
    here = F.struct(position, *ends, "_n")
    end = F.when(F.col("_closes"), here).otherwise(F.lead(here).over(window))
    return (
        rows.withColumn("_end", end)
        .filter("_opens")
        .withColumn("_size", (F.col("_end._n") - F.col("_n") + 1).cast("bigint"))
        .drop("_prev", "_next", "_opens", "_closes")
    )


def _named(position: str, ends: list[str], end: Column) -> list[Column]:
    columns = [position, *ends]
    return [F.col(c).alias(f"first_{c}") for c in columns] + [end[c].alias(f"last_{c}") for c in columns]


def fold_runs(df: DataFrame, keys: list[str], position: str, same: list[str], ends: list[str] = [],
              bits: int = BITS) -> DataFrame:
    """Fold a whole history: neighbours in order of position that agree on ``same``.

    Returns the keys, ``same``, first_/last_ of position and ``ends``, and ``count``.
    One shuffle, by (keys, bucket); runs across buckets are put together over
    one row per bucket.
    """
    key = ["_k"]
    rows = spread(df.select(F.struct(*keys, F.lit(0).alias("_")).alias("_k"), position, *ends, *same), key, position, bits)
    window = in_bucket(key, position)
    runs = _runs(rows, window, position, same, ends)

    per_bucket = (
        runs.groupBy(*key, BUCKET)
        .agg(
            F.min_by(F.struct("_same", "_size", "_end"), position).alias("opening"),
            F.max_by("_same", position).alias("last"),
            F.count("*").alias("runs"),
        )
        .withColumns({"first": F.col("opening._same"), "fresh": F.lit(False)})
    )
    seams = stitch(per_bucket, key, bits=bits)
    part = F.struct(BUCKET, F.col("opening._size").alias("size"), F.col("opening._end").alias("end"))
    offsets = gather_tails(seams, key, [], part, {
        "_more": lambda parts: F.sum(parts["size"]), "_tail": lambda parts: F.max_by(parts["end"], parts[BUCKET])})

    is_last = F.lead(position).over(window).isNull()
    runs = attach(runs.withColumn("_last", is_last), offsets, key)
    runs = runs.filter(~(F.col("crossing") & (F.col("_n") == 1)))
    more = F.when(F.col("_last"), F.col("_more"))
    end = F.coalesce(F.when(F.col("_last"), F.col("_tail")), F.col("_end"))
    return runs.select(
        *[F.col(f"_k.{k}").alias(k) for k in keys], *same, *_named(position, ends, end),
        (F.col("_size") + F.coalesce(more, F.lit(0))).alias("count"),
    )


def _folded(runs: DataFrame) -> DataFrame:
    return runs.select(
        "device",
        F.col("first_id").alias("start_id"), F.col("last_id").alias("end_id"),
        F.col("first_timestamp").alias("start_time"), F.col("last_timestamp").alias("end_time"),
        *SAME, "count",
    )


def fold_logs(logs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fold the whole history of every device (`schema.FOLDED`)."""
    return _folded(fold_runs(logs, ["device"], "id", SAME, ["timestamp"], bits))


def fold_entries(entries: DataFrame, limit: int) -> DataFrame:
    """Fold the rows of a limited query, newest run first, at most ``limit`` runs.

    For inputs that a limit bounds; `fold_logs` is for everything else.
    """
    window = Window.partitionBy("device").orderBy("id")
    runs = _runs(entries.select("device", "id", "timestamp", *SAME), window, "id", SAME, ["timestamp"])
    folded = _folded(runs.select("device", *SAME, *_named("id", ["timestamp"], F.col("_end")), F.col("_size").alias("count")))
    return folded.orderBy(F.desc("end_id")).limit(max(limit, 0))
