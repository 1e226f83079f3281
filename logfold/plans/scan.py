"""Ordered scans over a history of any length, without a one-task window.

A key's rows are cut into buckets of ``2**bits`` consecutive positions and
shuffled by (key, bucket), so that a hot key spreads over the cluster and a
window never sees more than one bucket. What a bucket needs from the rows
before it comes from `carry`: one summary row per bucket, scanned on two
levels. Positions are unique integers, so a bucket and a group of buckets hold
at most ``2**BITS`` rows each, and the top scan of a key holds one row per
``2**32`` positions.

Keys must not be null: a null key is never joined to the rows before it. A key
column that is declared nullable also costs a shared exchange, as Catalyst then
adds a null check to one of its readers; see `not_null`.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BITS = 16
BUCKET = "_b"


def not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    """Make string keys non-nullable, with "" for null."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})


def with_bucket(df: DataFrame, position: str, bits: int = BITS) -> DataFrame:
    return df.withColumn(BUCKET, F.shiftright(F.col(position), bits))


def spread(df: DataFrame, keys: list[str], position: str, bits: int = BITS) -> DataFrame:
    """Shuffle the rows by (keys, bucket).

    Written as an explicit repartition so that every branch reading the result
    shares one exchange. For that, each branch has to use all its columns.
    """
    return with_bucket(df, position, bits).repartition(*keys, BUCKET)


def in_bucket(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def attach(df: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    """Join bucket rows to the rows spread by the same keys; the big side stays put."""
    return df.join(per_bucket.hint("shuffle_hash"), [*keys, BUCKET], "left")


def _over(kind: str, column: str, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"max": F.max, "sum": F.sum}[kind](column).over(window)


def _combine(kind: str, above: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, above)
    if kind == "max":
        return F.greatest(above, here)
    zero = F.lit(0).cast("bigint")
    return F.coalesce(above, zero) + F.coalesce(here, zero)


def carry(summary: DataFrame, keys: list[str], kinds: dict[str, str], bits: int = BITS) -> DataFrame:
    """Add ``before_<column>``: the column combined over all earlier buckets of the key.

    ``summary`` has one row per (keys, bucket). ``kinds`` maps a column to
    "max", "sum" or "last" (last non-null value). Buckets are scanned in groups
    of ``2**bits``; the last row of a group stands for the group in a second
    scan, and hands the result back to its group. The chain reads ``summary``
    once, so stacked scans do not multiply the plan.
    """
    group = Window.partitionBy(*keys, "_group").orderBy(BUCKET)
    top = Window.partitionBy(*keys, "_end", "_side").orderBy("_group")
    whole = Window.partitionBy(*keys, "_group")
    rows = summary.withColumn("_group", F.shiftright(F.col(BUCKET), bits))
    rows = rows.withColumns(
        {f"_here_{c}": _over(k, c, before(group)) for c, k in kinds.items()}
        | {f"_total_{c}": _over(k, c, group) for c, k in kinds.items()}
        | {"_end": F.lead(BUCKET).over(group).isNull()}
    ).withColumn("_side", F.when(~F.col("_end"), F.col("_group")))
    rows = rows.withColumns({f"_above_{c}": _over(k, f"_total_{c}", before(top)) for c, k in kinds.items()})
    rows = rows.withColumns(
        {f"_above_{c}": F.max(F.when(F.col("_end"), F.col(f"_above_{c}"))).over(whole) for c in kinds}
    )
    found = {f"before_{c}": _combine(k, F.col(f"_above_{c}"), F.col(f"_here_{c}")) for c, k in kinds.items()}
    scratch = [f"_{p}_{c}" for c in kinds for p in ("here", "total", "above")]
    return rows.withColumns(found).drop("_group", "_end", "_side", *scratch)


def stitch(
    per_bucket: DataFrame, keys: list[str], sums: list[str] = [], initial: str | None = None, bits: int = BITS
) -> DataFrame:
    """Find the runs that go on across buckets, and number all runs of a key.

    ``per_bucket`` has, for every bucket, ``runs`` (how many runs it holds),
    the keys of its ``first`` and ``last`` row, ``fresh`` (true where the first
    row opens a run in any case) and the columns to add up. ``initial`` names a
    column with the key before the first bucket.

    Adds ``joined`` (the first run goes on from before), ``crossing`` (from an
    earlier bucket of this input), ``before_runs`` (runs opened in earlier
    buckets) and ``before_<sum>``. Groups of buckets as in `carry`.
    """

    def goes_on(first: Column, fresh: Column, previous: Column) -> Column:
        return F.coalesce(~fresh & (first == previous), F.lit(False)).cast("bigint")

    group = Window.partitionBy(*keys, "_group").orderBy(BUCKET)
    top = Window.partitionBy(*keys, "_end", "_side").orderBy("_group")
    whole = Window.partitionBy(*keys, "_group")
    handed = ["_gap", "_inside", "_above_runs", *[f"_above_{c}" for c in sums]]
    zero = F.lit(0).cast("bigint")

    rows = per_bucket.withColumn("_group", F.shiftright(F.col(BUCKET), bits))
    rows = rows.withColumns({
        "_prev": F.lag("last").over(group),
        "_open": F.first(F.struct("first", "fresh")).over(group),
        "_end": F.lead(BUCKET).over(group).isNull(),
    })
    rows = rows.withColumns({
        "_side": F.when(~F.col("_end"), F.col("_group")),
        "_joined": goes_on(F.col("first"), F.col("fresh"), F.col("_prev")),
    })
    rows = rows.withColumns(
        {"_here_runs": F.sum(F.col("runs") - F.col("_joined")).over(group)}
        | {f"_here_{c}": F.sum(c).over(group) for c in sums}
    )
    rows = rows.withColumn("_plast", F.lag("last").over(top))
    previous = F.coalesce("_plast", initial) if initial else F.col("_plast")
    rows = rows.withColumns({
        "_gap": goes_on(F.col("_open.first"), F.col("_open.fresh"), previous),
        "_inside": F.col("_plast").isNotNull().cast("bigint"),
    })
    rows = rows.withColumns(
        {"_above_runs": F.sum(F.col("_here_runs") - F.col("_gap")).over(before(top))}
        | {f"_above_{c}": F.sum(f"_here_{c}").over(before(top)) for c in sums}
    )
    rows = rows.withColumns({c: F.max(F.when(F.col("_end"), F.col(c))).over(whole) for c in handed})

    opens_group = F.col("_prev").isNull()
    joined = F.when(opens_group, F.col("_gap")).otherwise(F.col("_joined"))
    earlier = F.coalesce("_above_runs", zero) + F.col("_here_runs") - F.col("runs") + F.col("_joined")
    return rows.select(
        *per_bucket.columns,
        (joined == 1).alias("joined"),
        ((joined == 1) & (~opens_group | (F.col("_inside") == 1))).alias("crossing"),
        (earlier - F.when(opens_group, zero).otherwise(F.col("_gap"))).alias("before_runs"),
        *[(F.coalesce(f"_above_{c}", zero) + F.col(f"_here_{c}") - F.col(c)).alias(f"before_{c}") for c in sums],
    )


def gather_tails(
    seams: DataFrame, keys: list[str], columns: list[str], part: Column, totals: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per bucket: the columns, and ``totals`` of what later buckets hold of its last run.

    ``seams`` comes from `stitch`; ``part`` is a struct of what a bucket holds of the run that crosses into it, and
    ``totals`` maps a name to an aggregate of such structs. Parts are added up before they move, and a bucket that
    lies within a run moves under a key of its own, so no task holds the buckets of a long run.
    """
    number = F.col("before_runs") - F.col("joined").cast("bigint")
    inside = F.col("crossing") & (F.col("runs") == 1)
    never = F.lit(False)
    own = F.struct(BUCKET, "joined", "crossing", "runs", *columns)
    sent = F.array(
        F.struct(
            F.when(~inside, number + F.col("runs")).alias("run"), F.when(inside, F.col(BUCKET)).alias("alone"),
            own.alias("own"), F.when(never, part).alias("part"),
        ),
        F.when(
            F.col("crossing"),
            F.struct(
                (number + 1).alias("run"), F.when(never, F.col(BUCKET)).alias("alone"),
                F.when(never, own).alias("own"), part.alias("part"),
            ),
        ),
    )
    by_run = (
        seams.select(*keys, F.explode(sent).alias("sent"))
        .filter(F.col("sent").isNotNull())
        .groupBy(*keys, "sent.run", "sent.alone")
        .agg(
            # A run begins in one bucket.
            F.first("sent.own", ignorenulls=True).alias("_own"),
            *[total(F.col("sent.part")).alias(name) for name, total in totals.items()],
        )
    )
    return by_run.select(*keys, "_own.*", *totals)


def with_previous(
    df: DataFrame, keys: list[str], position: str, columns: list[str], bits: int = BITS
) -> DataFrame:
    """Add ``prev``: the given columns of the row before this one (null on a key's first row)."""
    value = F.struct(*columns)
    lasts = (
        with_bucket(df.select(*keys, position, *columns), position, bits)
        .groupBy(*keys, BUCKET)
        .agg(F.max_by(value, position).alias("last"))
    )
    seams = carry(lasts, keys, {"last": "last"}, bits=bits).drop("last")
    rows = attach(spread(df, keys, position, bits), seams, keys)
    lag = F.lag(value).over(in_bucket(keys, position))
    return rows.withColumn("prev", F.coalesce(lag, F.col("before_last"))).drop(BUCKET, "before_last")


def with_row_number(df: DataFrame, keys: list[str], position: str, name: str, bits: int = BITS) -> DataFrame:
    """Number a key's rows from 1 in order of position."""
    counts = with_bucket(df.select(*keys, position), position, bits).groupBy(*keys, BUCKET)
    offsets = carry(counts.agg(F.count("*").alias("rows")), keys, {"rows": "sum"}, bits=bits).drop("rows")
    rows = attach(spread(df, keys, position, bits), offsets, keys)
    number = F.row_number().over(in_bucket(keys, position)) + F.coalesce("before_rows", F.lit(0))
    return rows.withColumn(name, number.cast("bigint")).drop(BUCKET, "before_rows")
