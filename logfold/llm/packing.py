"""Best-fit packing of texts into sequences, without conflicts inside a sequence.

Texts longer than a sequence are cut into pieces of its length and a rest, so nothing is dropped. Pieces
are dealt out to shards of bounded size by a hash. In a shard the longest piece comes first. Open
bins are held in order of their free room; each carries two bitmaps, of the sources and of the
duplicate clusters in it. The search starts at the smallest room that is large enough and goes on to
the next until a bin without conflict is found: the tightest compatible one. If there is none, a bin is opened.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import lower_ascii, partitions, text_of

CAPACITY = 16_384
SHARD_PIECES = 2_048
OUT = ["bin_id", "doc_id", "piece", "start", "length", "free", "source"]


def pack(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of every piece, given in order of placing, and the room left in each bin.

    Sources and clusters are small numbers; below zero they conflict with nothing.
    """
    rooms: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect.bisect_left(rooms, (length, -1))
        while at < len(rooms) and (source_bits[rooms[at][1]] & s or cluster_bits[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            room, chosen = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[chosen] |= s
        cluster_bits[chosen] |= c
        bisect.insort(rooms, (room - length, chosen))
        placed.append(chosen)
    free = [0] * len(source_bits)
    for room, chosen in rooms:
        free[chosen] = room
    return placed, free


def _numbers(values: list, shared_only: bool) -> list[int]:
    """Values as small numbers; nulls, and on demand values that occur once, are below zero."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    index: dict = {}
    return [-1 if v is None or (shared_only and count[v] == 1) else index.setdefault(v, len(index)) for v in values]


def best_fit(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str | None = "source", capacity: int = CAPACITY,
             shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of a text: its bin, place in the text (start, length in code points), and the room left in its bin.

    A bin holds one source and one duplicate cluster (texts equal but for the case of A-Z) at most once; pieces of
    one text share its source and cluster, so they go to different bins. Null sources conflict with nothing, null texts
    are empty; empty texts are pieces of length 0 and part of no cluster. Ids are carried only: repeated rows are cluster
    mates, and a null id stays null. Equal lengths are placed by id, start and cluster. An empty table gives no rows.
    """
    length = F.char_length("_text")
    rows = docs.select(
        F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("_text"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"))
    rows = rows.select("doc_id", "source", length.alias("_length"), F.when(length > 0, F.xxhash64(lower_ascii(F.col("_text")))).alias("cluster"))
    number = F.greatest(F.ceil(F.col("_length") / capacity), F.lit(1)).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    start = F.col("piece").cast("bigint") * capacity
    cut = cut.select("doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.col("_length") - start, F.lit(capacity)).cast("int").alias("length"))

    pieces = rows.agg(F.sum(number)).scalar()
    shards = F.greatest(F.ceil(F.coalesce(pieces, F.lit(1)) / shard_pieces), F.lit(1)).cast("int")
    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster"), shards).cast("int")

    def run(key, data):
        # Nulls come last on both ways, so the order is the same in every run.
        data = data.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("cluster", "ascending")])
        column = {c: data.column(c).to_pylist() for c in ("length", "source", "cluster")}
        placed, free = pack(column["length"], _numbers(column["source"], False), _numbers(column["cluster"], True), capacity)
        bins = np.array(placed, np.int64)
        return pa.table({
            "bin_id": (key[0].as_py() << 24) + bins, "doc_id": data.column("doc_id"), "piece": data.column("piece"),
            "start": data.column("start"), "length": data.column("length"), "free": pa.array(np.array(free, np.int32)[bins]),
            "source": data.column("source"),
        })

    # A fixed number of tasks: pieces are few bytes and much search, and adaptive execution would join tasks by bytes.
    dealt = cut.withColumn("_shard", shard).repartition(partitions(docs.sparkSession), "_shard")
    return dealt.groupBy("_shard").applyInArrow(
        run, "bin_id bigint, doc_id bigint, piece int, start bigint, length int, free int, source string")
