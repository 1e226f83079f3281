"""Broadcasting behind a check of size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 250_000
# Bytes of compressed files whose contents are broadcast.
MAX_BROADCAST_BYTES = 8 << 20


def few_rows(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if the frame has at most this many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, small: bool) -> DataFrame:
    """The frame, marked for broadcast where its size was checked; else Spark joins by shuffle."""
    return F.broadcast(df) if small else df
