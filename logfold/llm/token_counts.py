"""Token counts without token ids.

Texts are read in blocks. A block has one dictionary of its distinct pre-tokens and, per document,
the frequencies of its pre-tokens as numbers of that dictionary. The dictionaries meet by
pre-token: each distinct one is sorted next to its equals and counted once. The counts go back to
their blocks, where a document's number of tokens is the sum of frequency times count.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.arrow import pieces, rows_of
from logfold.llm.common import small_batches, text_of
from logfold.llm.pretokens import Pieces, Splitter

LIMIT = 1024
BLOCK_BYTES = 12 << 20
# Counted pre-tokens that are sent back to their blocks together.
SENT = 200_000
PACKED = "block bigint, dictionary binary, ids binary, bytes binary, sizes binary, places binary, times binary"


def _pack(values, kind) -> bytes:
    return zstandard.compress(np.asarray(values, kind).tobytes(), 3)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _blocks(split: Splitter):
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(pieces(batches, "_text", BLOCK_BYTES)):
            index: dict[str, int] = {}
            sizes, lengths, places, times = [], [], [], []
            for text in batch.column("_text"):
                text = text.as_py()
                found = Counter(split(text))
                lengths.append(len(text.encode()))
                sizes.append(len(found))
                place = np.array([index.setdefault(p, len(index)) for p in found], np.int64)
                order = np.argsort(place)
                # Steps from one place to the next are small numbers, which pack well.
                places.append(np.diff(place[order], prepend=0).astype(np.uint32))
                times.append(np.fromiter(found.values(), np.uint32, len(found))[order])
            ends = np.cumsum([len(p.encode()) for p in index], dtype=np.int64)
            ids = batch.column("_id")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                (first + n, pa.int64()),
                (zstandard.compress(len(index).to_bytes(8, "little") + ends.tobytes() + "".join(index).encode(), 3), pa.binary()),
                (_pack(ids.to_numpy(zero_copy_only=False), "<i8"), pa.binary()),
                (_pack(lengths, "<i8"), pa.binary()), (_pack(sizes, "<u4"), pa.binary()),
                (_pack(np.concatenate([np.zeros(0, np.uint32), *places]), "<u4"), pa.binary()),
                (_pack(np.concatenate([np.zeros(0, np.uint32), *times]), "<u4"), pa.binary()),
            )], ["block", "dictionary", "ids", "bytes", "sizes", "places", "times"])

    return run


def _entries(batches):
    """One row per pre-token of a block's dictionary."""
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("dictionary")):
            data = zstandard.decompress(blob.as_py())
            n = int.from_bytes(data[:8], "little")
            ends = np.frombuffer(data, "<i8", n, 8)
            text = data[8 + 8 * n:]
            starts = [0, *ends[:-1].tolist()] if n else []
            found = [text[a:b] for a, b in zip(starts, ends.tolist())]
            for k in range(0, n, 50_000):
                part = found[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part, pa.binary()), pa.array(np.full(len(part), block, np.int64)),
                    pa.array(np.arange(k, k + len(part), dtype=np.int32)),
                ], ["piece", "block", "place"])


def _counted(path: str):
    """Sorted pre-tokens in, (block, places, counts) out; equal ones are neighbours and counted once."""

    def by_block(rows):
        block, place, count = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(block, kind="stable")
        block, place, count = block[order], place[order], count[order]
        cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        ends = [*cuts[1:], len(block)]
        return pa.RecordBatch.from_arrays([
            pa.array(block[cuts]), pa.array([_pack(place[a:b], "<u4") for a, b in zip(cuts, ends)], pa.binary()),
            pa.array([_pack(count[a:b], "<u4") for a, b in zip(cuts, ends)], pa.binary()),
        ], ["block", "counted", "counts"])

    def run(batches):
        vocabulary = Pieces(path)
        last, last_count, rows, held = None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("piece").to_pylist()
            fresh = [i for i, p in enumerate(column) if p != (column[i - 1] if i else last)]
            counts = vocabulary.counts([column[i].decode() for i in fresh])
            of = np.cumsum(np.isin(np.arange(len(column)), fresh)) - 1
            known = np.array([last_count, *counts], np.uint32)[of + 1]
            last, last_count = column[-1], int(known[-1])
            rows.append((np.asarray(batch.column("block")), np.asarray(batch.column("place")), known))
            held += len(column)
            if held >= SENT:
                yield by_block(rows)
                rows, held = [], 0
        if rows:
            yield by_block(rows)

    return run


def _summed(batches):
    for row in rows_of(batches):
        ids, lengths, sizes = _unpack(row["ids"], "<i8"), _unpack(row["bytes"], "<i8"), _unpack(row["sizes"], "<u4")
        steps, times = np.cumsum(_unpack(row["places"], "<u4"), dtype=np.int64), _unpack(row["times"], "<u4")
        before = np.concatenate([[0], steps])[np.cumsum(sizes, dtype=np.int64) - sizes]
        places = steps - np.repeat(before, sizes)
        counts = np.zeros(int(places.max(initial=0)) + 1, np.int64)
        for part in row["counted"] or []:
            counts[_unpack(part["counted"], "<u4")] = _unpack(part["counts"], "<u4")
        total = np.concatenate([[0], np.cumsum(counts[places] * times)])
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(lengths), pa.array(total[ends] - total[ends - sizes], pa.int64())],
            ["_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the vocabulary at ``path`` counts it.

    ``path`` is a byte-level file of the tokenizers library that executors can read. A null text is empty
    and has no tokens. Ids are whole numbers and are only carried: repeated rows stay, and a null id gives
    a null. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    null = -(1 << 63)
    source = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(null)).alias("_id"), text_of(text).alias("_text"))
    # Both uses read all columns, so that they share one exchange and the texts are split once.
    packed = source.mapInArrow(_blocks(Pieces(path).split), PACKED).repartition("block")
    entries = packed.mapInArrow(_entries, "piece binary, block bigint, place int")
    ordered = entries.repartition("piece").sortWithinPartitions("piece")
    counted = ordered.mapInArrow(_counted(path), "block bigint, counted binary, counts binary")
    counted = counted.groupBy("block").agg(F.collect_list(F.struct("counted", "counts")).alias("counted"))
    summed = packed.join(counted, "block", "left").mapInArrow(_summed, "_id bigint, n_bytes bigint, n_tokens bigint")
    return summed.select(
        F.nullif("_id", F.lit(null)).alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
