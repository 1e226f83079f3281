"""BPE encoding and decoding with reuse of chunks that documents share.

A rolling hash over 24 characters cuts texts where their content says so, so that equal passages are
cut alike wherever they stand. A chunk is trimmed to its core, from its first to its last blank that follows something
else. Cores that occur more than once are encoded once and their ids sent to all texts that hold them. The joins
are repaired: the text between two cores is encoded anew together with a stretch of both, and what it says of these
stretches is compared with the ids of the cores. Where they differ, more of the cores is taken, up to
all of them, until both agree; a text without cores is encoded whole.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.arrow import pieces, rows_of
from logfold.llm.common import join_groups, small_batches, text_of
from logfold.llm.pretokens import Pieces, special_tokens

WINDOW, MEAN_BITS = 24, 10
LEAST, MOST = 128, 8192
CORE_LEAST = 64
# Characters of a core that a join is encoded with at first; four times as many at each try after that.
STRETCH = 24
BLANK = re.compile(r"(?<=\S) ")
# Bytes of text in one batch of results.
BATCH_BYTES = 256 << 10
BLOCK_BYTES = 1 << 20
PACKED = "block bigint, texts binary, ids binary, cores array<struct<doc:int,start:int,end:int,digest:binary>>"
CORE = pa.struct([("doc", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.array([*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def chunk_cuts(points: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, given as code points."""
    n = len(points)
    if n <= LEAST:
        return [n]
    up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * down)
    window = sums.copy()
    window[WINDOW:] -= sums[:-WINDOW]
    hashed = (window * up) >> np.uint64(64 - MEAN_BITS)
    cuts, last = [], 0
    for cut in [*(np.flatnonzero(hashed == 0) + 1).tolist(), n]:
        while cut - last > MOST:
            last += MOST
            cuts.append(last)
        if cut - last >= LEAST or cut == n:
            last = cut
            cuts.append(cut)
    return cuts


def cores(text: str) -> list[tuple[int, int]]:
    """Where the cores of a text begin and end, in code points; they do not overlap."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = np.isin(points, _SPACES)
    safe = np.flatnonzero((points[1:] == 32) & ~blank[:-1]) + 1
    safe = np.concatenate([[0], safe, [len(points)]])
    cuts = chunk_cuts(points)
    first = safe[np.searchsorted(safe, [0, *cuts[:-1]])]
    last = safe[np.searchsorted(safe, cuts, "right") - 1]
    return [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= CORE_LEAST]


def _packed(path: str):
    # A special token with white space could reach into a core; texts are then encoded whole.
    whole = any(c.isspace() for t in special_tokens(path) for c in t)

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(pieces(batches, "_text", BLOCK_BYTES)):
            texts = batch.column("_text").to_pylist()
            found = [
                {"doc": i, "start": a, "end": b, "digest": hashlib.blake2b(t[a:b].encode(), digest_size=16).digest()}
                for i, t in enumerate(texts) for a, b in ([] if whole else cores(t))
            ]
            yield pa.RecordBatch.from_arrays([
                pa.array([first + n]), pa.array([_pack_texts(texts)], pa.binary()),
                pa.array([batch.column("_id").to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([found], pa.list_(CORE)),
            ], ["block", "texts", "ids", "cores"])

    return run


def _pack_texts(texts: list[str]) -> bytes:
    data = [t.encode() for t in texts]
    return zstandard.compress(np.array([len(data), *map(len, data)], "<i8").tobytes() + b"".join(data), 3)


def _unpack_texts(blob: bytes) -> list[str]:
    data = zstandard.decompress(blob)
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8)) + 8 + 8 * n
    return [data[a:b].decode() for a, b in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist())]


def _references(batches):
    for batch in batches:
        for block, found in zip(batch.column("block").to_pylist(), batch.column("cores").to_pylist()):
            yield pa.RecordBatch.from_arrays([
                pa.array([c["digest"] for c in found], pa.binary()), pa.array(np.full(len(found), block, np.int64)),
                pa.array(np.arange(len(found), dtype=np.int32)),
            ], ["digest", "block", "place"])


def _encoded_cores(path: str):
    def run(batches):
        vocabulary = Pieces(path)
        # A left join and a filter here, since an inner join would filter below the shared exchange.
        for row in rows_of(b.filter(pa.compute.is_valid(b.column("wanted"))) for b in batches):
            texts, wanted = _unpack_texts(row["texts"]), [row["cores"][p] for p in row["wanted"]]
            ids = vocabulary.encode([texts[c["doc"]][c["start"]:c["end"]] for c in wanted])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c["digest"] for c in wanted], pa.binary()), pa.array(ids, pa.binary())], ["digest", "core_ids"])

    return run


def repaired(text: str, left: tuple[int, int, bytes], right: tuple[int, int, bytes], vocabulary: Pieces) -> tuple[int, int, bytes]:
    """Two neighbouring cores (start, end, ids) of a text as one, with the text between them.

    The join is encoded with a stretch of either core, and both stretches must have the ids that they have in
    their cores. They are widened until they do, at last to the whole cores, which then need not agree.
    """
    (a, b, before), (c, d, after) = left, right
    wide = STRETCH
    while True:
        start, end = max(a, b - wide), min(d, c + wide)
        # Stretches begin and end before a blank that follows something else, as cores do.
        start = a if start == a else next((m.start() for m in BLANK.finditer(text, start, b)), -1)
        end = d if end == d else max((m.start() for m in BLANK.finditer(text, c + 1, end)), default=-1)
        if start >= 0 and (end > c or end == d):
            pieces_ = vocabulary.split(text[start:end])
            ids = vocabulary.ids_of(pieces_)
            if start == a and end == d:
                return a, d, b"".join(ids)
            own, new, theirs = _three(pieces_, ids, b - start, c - start)
            if own is not None and before.endswith(own) and after.startswith(theirs):
                return a, d, b"".join([before, new, after])
        wide *= 4


def _three(pieces_: list[str], ids: list[bytes], first: int, second: int) -> tuple[bytes | None, bytes, bytes]:
    """The ids up to place ``first``, from there to ``second``, and after it; None if a piece lies across one of the places."""
    ends = np.cumsum([0, *map(len, pieces_)])
    i, j = (int(np.searchsorted(ends, x)) for x in (first, second))
    if ends[i] != first or ends[j] != second:
        return None, b"", b""
    return b"".join(ids[:i]), b"".join(ids[i:j]), b"".join(ids[j:])


def stitched(text: str, known: list[tuple[int, int, bytes]], vocabulary: Pieces) -> bytes:
    """Ids of a whole text from those of some of its cores (start, end, ids)."""
    # What is empty agrees with anything, so the ends of the text are cores of their own.
    parts = [(0, 0, b""), *known, (len(text), len(text), b"")]
    if len(known) == 0:
        return vocabulary.encode([text])[0]
    out, (a, b, ids) = [], parts[0]
    for part in parts[1:]:
        # Ids that no later repair can reach are put aside; a core never needs more than its own text.
        a, b, joined = repaired(text, (a, b, ids), part, vocabulary)
        kept = len(joined) - len(part[2])
        if part[2] and joined.endswith(part[2]):
            out.append(joined[:kept])
            a, b, ids = part
        else:
            ids = joined
    return b"".join([*out, ids])


def _assembled(path: str, decoded: bool):
    def run(batches):
        vocabulary = Pieces(path)
        read = vocabulary.decoder() if decoded else None
        for row in rows_of(batches):
            texts, numbers = _unpack_texts(row["texts"]), np.frombuffer(row["ids"], "<i8")
            shared = [[] for _ in texts]
            for s in sorted(row["shared"] or [], key=lambda s: s["place"]):
                c = row["cores"][s["place"]]
                shared[c["doc"]].append((c["start"], c["end"], s["core_ids"]))
            start, ids, held = 0, [], 0
            for k, (text, known) in enumerate(zip(texts, shared)):
                found = stitched(text, known, vocabulary)
                ids.append(found if vocabulary.type.itemsize == 4 else np.frombuffer(found, "<u2").astype("<u4").tobytes())
                held += len(text)
                if held >= BATCH_BYTES or k + 1 == len(texts):
                    columns = [pa.array(numbers[start:k + 1]), pa.array(ids, pa.binary())]
                    if decoded:
                        columns.append(pa.array([read(np.frombuffer(i, "<u4").tolist()) for i in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "ids", "text"][:len(columns)])
                    start, ids, held = k + 1, [], 0

    return run


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: token ids as little-endian unsigned 32-bit integers; with ``decoded`` also the text that they give.

    ``path`` is a byte-level file of the tokenizers library that executors can read. A null text is empty and
    has no ids. Ids of rows are whole numbers and only carried: repeated rows stay, a null stays null.
    Other columns are not read. Texts of any length are encoded whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    null = -(1 << 63)
    source = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(null)).alias("_id"), text_of(text).alias("_text"))
    # Every use reads all columns, so that they share one exchange and the texts are cut once.
    packed = source.mapInArrow(_packed(path), PACKED).repartition("block")
    references = packed.mapInArrow(_references, "digest binary, block bigint, place int")
    groups = references.groupBy("digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("block", "place")).alias("first")).filter("_n > 1")
    wanted = groups.select("first.*").groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("wanted"))
    once = packed.join(wanted, "block", "left").mapInArrow(_encoded_cores(path), "digest binary, core_ids binary")
    sizes = groups.select("digest", "_n")
    known = once.join(sizes.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest")).drop("_digest")
    sent = join_groups(references, known, "digest", "place", "inner", sizes).groupBy("block").agg(
        F.collect_list(F.struct("place", "core_ids")).alias("shared"))
    whole = packed.join(sent, "block", "left").mapInArrow(
        _assembled(path, decoded), "_id bigint, ids binary" + ", text string" * decoded)
    return whole.withColumn("_id", F.nullif("_id", F.lit(null))).withColumnRenamed("_id", id)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for rows of `encode`; null ids give a null text."""

    def run(batches):
        read = Pieces(path).decoder()
        for batch in batches:
            texts = [None if i is None else read(np.frombuffer(i, "<u4").tolist()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_ids", "_text"])

    out = encoded.select(F.col(id).cast("bigint"), ids).mapInArrow(run, "_id bigint, _ids binary, _text string")
    return out.select(F.col("_id").alias(id), F.col("_ids").alias(ids), F.col("_text").alias("text"))
