"""A skip index beside stored records: which blocks of ids hold which three characters in a row.

Rows are (device, gram, first_id, last_id, upto), sorted by device and gram, so a search reads the few row groups with
its own grams. A block is ``2**BLOCK_BITS`` ids of a device, from first_id to last_id. Grams are taken from messages with
ASCII letters in lower case, as searches ignore their case. The gram "" marks every indexed block; its ``upto`` is the
newest id that the index has seen there.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BLOCK_BITS = 12
# Blocks that a search looks up and ranges of them in its filter; with more, it reads as if there were no index.
MAX_BLOCKS, MAX_RANGES = 4096, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "gram string, first_id bigint, last_id bigint, upto bigint, device string"
COLUMNS = ["device", "gram", "first_id", "last_id", "upto"]
# Every place of a text with the characters from there on, in one pass whatever its length.
GRAMS = "(?s)(?=(" + "." * GRAM + "))"


def search_index(logs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The grams of each block of records, each once. A null or short message has none, but its block has its mark."""
    found = F.array_distinct(F.regexp_extract_all(F.translate("message", UPPER, LOWER), F.lit(GRAMS), F.lit(1)))
    grams = F.concat(F.array(F.lit("")), F.coalesce(found, F.array().cast("array<string>")))
    rows = logs.select("device", "id", F.shiftright("id", bits).alias("_block"), F.explode(grams).alias("gram"))
    blocks = rows.groupBy("device", "gram", "_block").agg(F.max("id").alias("upto"))
    first = F.shiftleft("_block", bits)
    return blocks.withColumns({"first_id": first, "last_id": first + ((1 << bits) - 1)}).select(COLUMNS)


def write_search_index(logs: DataFrame, path: str, mode: str = "append", bits: int = BLOCK_BITS) -> None:
    """Index records that are stored; a gram that most blocks hold is cut by blocks, so no task has all of it.

    To go on after more records came, add the index of those from `indexed_upto` on: that record too, as text may
    have been appended to it.
    """
    found = search_index(logs, bits).withColumn("_slice", F.shiftright("first_id", bits + 16))
    ordered = found.repartition("device", "gram", "_slice").sortWithinPartitions("device", "gram", "first_id").drop("_slice")
    ordered.write.mode(mode).partitionBy("device").parquet(path)


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(COLUMNS)


def indexed_upto(index: DataFrame, device: str) -> int | None:
    """The newest indexed id of a device."""
    return index.filter((F.col("device") == device) & (F.col("gram") == "")).agg(F.max("upto")).first()[0]


def grams_of(query: str) -> list[str]:
    """Grams that every message with this text has; none if no stretch between wildcards is long enough."""
    stretches = re.split("[%_]", query.translate(str.maketrans(UPPER, LOWER)))
    return sorted({s[at:at + GRAM] for s in stretches for at in range(len(s) - GRAM + 1)})


def _ranges(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Blocks with those that follow each other made one."""
    ranges = []
    for first, last in sorted(blocks):
        if ranges and first <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
        else:
            ranges.append((first, last))
    return ranges


def skip_blocks(logs: DataFrame, index: DataFrame, device: str, query: str) -> DataFrame:
    """Records of a device without the blocks that cannot have the text in a message.

    What is left need not have the text: a search looks at it itself. Records that are newer than the index stay, and so
    does its newest one. The filter is on ids alone, so it reaches the files, which are sorted by id.
    """
    own, grams = logs.filter(F.col("device") == device), grams_of(query)
    upto = indexed_upto(index, device) if grams else None
    if upto is None:
        return own
    rows = index.filter((F.col("device") == device) & F.col("gram").isin(grams))
    held = rows.groupBy("first_id", "last_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    # A text in more blocks than come to the driver here is no rare one.
    blocks = held.select("first_id", "last_id").limit(MAX_BLOCKS + 1).collect()
    ranges = _ranges([tuple(b) for b in blocks])
    if len(blocks) > MAX_BLOCKS or len(ranges) > MAX_RANGES:
        return own
    near = F.col("id") >= upto
    for first, last in ranges:
        near = near | F.col("id").between(first, last)
    return own.filter(near)
