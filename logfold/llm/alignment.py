"""Alignment of the tokens of two vocabularies, and how often their ids meet over a whole corpus.

Tokenizer A is a byte-level file of the tokenizers library, B a model of sentencepiece. Both give spans in
characters of the text, which cut it coarsely (sentencepiece by its offset mapping: the version at hand refuses immutable protos). Where a span is not as wide as its token's own
bytes (parts of a multibyte character, byte-fallback tokens), the decoded bytes place the end. Places
where tokens of both end cut a text into groups; A and B tokens with overlapping bytes are links.

Texts are aligned by segments: a place before a blank that follows something else, or between a
Latin letter and an ASCII mark, is never inside a token of either vocabulary and changes no token beside
it, if no piece of B holds such a pair of characters. Vocabularies for which that is not so are aligned by
whole texts. A block of documents aligns each of its distinct segments once, but for those that its task still knows, and has one dictionary of its
(A id, B id) pairs; dictionaries meet by pair, with sums before the shuffle, and the counts go back to
the blocks. A block has one row for a pair, so no pair is a larger share of these rows than one of a block's pairs.
"""

import gc
import json
import os
import re
from array import array
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logfold.llm.arrow import pieces, rows_of
from logfold.llm.common import small_batches, text_of

BLOCK_BYTES = 8 << 20
# Characters of segments that the libraries get at once.
CHUNK = 1 << 16
# Bytes of parts and what they align to that a task keeps from block to block, and that one part and its characters take, about.
CACHED_BYTES, ENTRY_BYTES, CHARACTER_BYTES = 160 << 20, 300, 16
# Bytes of groups in one batch of results.
BATCH_BYTES = 2 << 20
MARK = "▁"
# Letters and marks between which texts are cut; fixed in all versions of Unicode.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
ASCII_MARKS = r"\x00-\x1f!-/:-@\[-`{-~"
BETWEEN = re.compile(f"(?<=[{LATIN}])(?=[{ASCII_MARKS}])")
PAIR = re.compile(f"[{LATIN}][{ASCII_MARKS}]")
WIDE = re.compile(r"\s ")
# Ends in a letter, so a segment that begins with a mark can stand behind it.
CARRIER = " a"
PACKED = "block bigint, pairs binary, met binary, segments binary, groups binary, ids binary, sizes binary, places binary"
ROWS = "_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"

# Byte-level vocabularies write bytes as characters: printable ones as they are, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Aligned:
    """What segments align to: per segment numbers of A and B tokens, groups and links, its groups as text, and its links."""

    def __init__(self, counts: np.ndarray, groups: list[str], links: np.ndarray, valid: np.ndarray):
        self.counts, self.groups, self.links, self.valid = counts, groups, links, valid
        self.ends = np.cumsum(counts[:, 3])

    def add(self, more: "Aligned") -> None:
        """Put other segments behind these."""
        both = [np.concatenate([x, y]) for x, y in ((self.counts, more.counts), (self.links, more.links), (self.valid, more.valid))]
        self.groups += more.groups
        self.counts, self.links, self.valid = both
        self.ends = np.cumsum(self.counts[:, 3])


class Aligner:
    """Two vocabularies: a byte-level file of the tokenizers library and a sentencepiece model."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in _CHARS for c in token)
            self.bytes_a[i] = bytes(_CHARS[c] for c in token) if known else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)
        ]
        numbers = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.shown, self.shown_first, self.shown_other = (np.array([f"{sign}{i}" for i in numbers], object) for sign in ",;|")
        self.wide_a, self.wide_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        plain = [p for i, p in enumerate(names) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        self.by_words = self._byte_level() and self._plain_model(path_b) and not any(MARK in p.lstrip(MARK) for p in plain)
        self.by_marks = self.by_words and not any(PAIR.search(p) for p in plain)

        self._forget()

    def _forget(self):
        """Start again without parts that are known."""
        self._index, self._held = _numbered(), 0
        self._known = Aligned(np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64), np.zeros(0, bool))

    def _byte_level(self) -> bool:
        """True if A cuts texts by the usual pattern and changes nothing before."""
        spec = json.loads(self.a.to_str())
        cut = spec.get("pre_tokenizer") or {}
        added = [t for t in spec.get("added_tokens", []) if not t.get("special")]
        return spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not (
            cut.get("add_prefix_space") or added)

    @staticmethod
    def _plain_model(path: str) -> bool:
        """True if B is a BPE model that leaves texts as they are, but for the blank before."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how, made = model.normalizer_spec, model.trainer_spec
        return (how.name == "identity" and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
                and made.model_type == 2 and not made.user_defined_symbols and not made.treat_whitespace_as_suffix)

    def words(self, text: str) -> list[str]:
        """Segments of blank + text, without the blank that each begins with."""
        if not self.by_words:
            return [text]
        parts = text.split(" ")
        if not WIDE.search(" " + text):
            return parts
        out, open_ = [], False
        for part in parts:
            if open_:
                out[-1] += " " + part
            else:
                out.append(part)
            # A blank after white space, or after the first blank, goes on with the segment.
            open_ = not part or part[-1].isspace()
        return out

    def _spans(self, ids: np.ndarray, wide: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """Ends of tokens in bytes: those of spans (begin, end) as wide as the token, else by the bytes of tokens before."""
        placed = np.cumsum(wide[ids])
        exact = coarse[:, 1] - coarse[:, 0] == wide[ids]
        return np.where(exact, coarse[:, 1], placed)

    def _tokens(self, text: str):
        """Ids and ends in bytes of A and B over blank + text; None where the bytes of the tokens are not the text."""
        full = " " + text
        data = full.encode()
        byte_of = np.zeros(len(full) + 1, np.int64)
        if len(data) == len(full):
            byte_of[:] = np.arange(len(full) + 1)
        else:
            points = np.frombuffer(full.encode("utf-32-le"), "<u4")
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF), out=byte_of[1:])
        found = self.a.encode(full, add_special_tokens=False)
        list_a = found.ids
        ids_a = np.array(list_a, np.int64)
        ends_a = self._spans(ids_a, self.wide_a, byte_of[_pairs(found.offsets)])
        found = self.b.encode(text, return_type="offset_mapping", num_threads=1)
        list_b = found["ids"]
        ids_b = np.array(list_b, np.int64)
        # Of the text, to which B adds the blank before: the first span has it as well.
        coarse = _pairs(found["offsets"]) + 1
        coarse[:1, 0] = 0
        ends_b = self._spans(ids_b, self.wide_b, byte_of[coarse])
        same = (b"".join([self.bytes_a[i] for i in list_a]) == data == b"".join([self.bytes_b[i] for i in list_b])
                and np.array_equal(ends_a, np.cumsum(self.wide_a[ids_a])) and np.array_equal(ends_b, np.cumsum(self.wide_b[ids_b])))
        return (ids_a, ends_a, ids_b, ends_b) if same else None

    def _chunk(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Aligned | None:
        """Alignment of the stretches (starts, ends), in bytes of blank + text; None if the tokens are not the text."""
        found = self._tokens(text)
        if found is None:
            return None
        ids_a, ends_a, ids_b, ends_b = found
        # Marks at bytes spare sorting what is sorted: 1 where A ends a token, 3 where both do.
        met = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        met[ends_a] = 1
        met[ends_b] |= 2
        both = np.flatnonzero(met == 3)
        if not ((met[ends] == 3).all() and ((met[starts] == 3) | (starts == 0)).all()):
            raise ValueError("a token reaches beyond its segment")
        # The tokens of a B token's links follow one another.
        begins_b = ends_b - self.wide_b[ids_b]
        first = np.searchsorted(ends_a, begins_b, "right")
        width = np.searchsorted(ends_a, ends_b, "left") + 1 - first
        total = np.cumsum(width)
        at = np.arange(int(width.sum())) - np.repeat(total - width, width) + np.repeat(first, width)
        links = (ids_a[at] << 32) | np.repeat(ids_b, width)
        place = lambda of: (np.searchsorted(of, starts, "right"), np.searchsorted(of, ends, "right"))
        (a0, a1), (b0, b1), (g0, g1) = place(ends_a), place(ends_b), place(both)
        total = np.append(0, total)
        l0, l1 = total[b0], total[b1]
        # The ids in the order of groups, A before B, each with the sign before it.
        cuts_a, cuts_b = (np.append(0, np.searchsorted(e, both, "right")) for e in (ends_a, ends_b))
        shown = np.empty(len(ids_a) + len(ids_b), object)
        shown[np.arange(len(ids_a)) + np.repeat(cuts_b[:-1], np.diff(cuts_a))] = self.shown[ids_a]
        shown[np.arange(len(ids_b)) + np.repeat(cuts_a[1:], np.diff(cuts_b))] = self.shown[ids_b]
        shown[cuts_a[:-1] + cuts_b[:-1]] = self.shown_first[ids_a[cuts_a[:-1]]]
        shown[cuts_a[1:] + cuts_b[:-1]] = self.shown_other[ids_b[cuts_b[:-1]]]
        shown = shown.tolist()
        groups = ["".join(shown[a:b])[1:] for a, b in zip((a0 + b0).tolist(), (a1 + b1).tolist())]
        keep = np.zeros(len(links) + 1, np.int64)
        np.add.at(keep, l0, 1)
        np.add.at(keep, l1, -1)
        counts = np.stack([a1 - a0, b1 - b0, g1 - g0, l1 - l0], 1)
        return Aligned(counts, groups, links[np.cumsum(keep[:-1]) > 0], np.ones(len(starts), bool))

    def _alone(self, segment: str) -> Aligned:
        """One segment for itself, which may have no tokens."""
        # The blank that ends a text stands behind the carrier too: of an empty text B has no tokens, not even its blank.
        text = segment[1:] if segment[:1] == " " and segment != " " else CARRIER[1:] + segment
        found = self._chunk(text, np.array([len(f" {text}".encode()) - len(segment.encode())]), np.array([len(f" {text}".encode())]))
        return found or Aligned(np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), np.zeros(1, bool))

    def _small(self, segments: list[str]) -> Aligned:
        """Segments that begin with a blank, or with a mark where a letter may stand before; many are encoded in one go."""
        parts, chunk, size = [], [], 0

        def close():
            found = None
            if len(chunk) > 1:
                shown = [s if s[0] == " " else CARRIER + s for s in chunk]
                text = "".join(shown)
                wide = np.array([*map(len, shown if text.isascii() else map(str.encode, shown))], np.int64)
                ends = np.cumsum(wide)
                carried = np.array([s[0] != " " for s in chunk])
                found = self._chunk(text[1:], ends - wide + len(CARRIER) * carried, ends)
            parts.extend([found] if found else map(self._alone, chunk))

        for segment in segments:
            # Only what ends in something else than white space can have others behind it.
            alone = not self.by_words or not segment.strip() or segment[-1].isspace()
            if chunk and (alone or size + len(segment) > CHUNK):
                close()
                chunk, size = [], 0
            chunk.append(segment)
            size += len(segment)
            if alone:
                close()
                chunk, size = [], 0
        if chunk:
            close()
        if not parts:
            return Aligned(np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64), np.zeros(0, bool))
        return Aligned(np.concatenate([p.counts for p in parts]), [g for p in parts for g in p.groups],
                       np.concatenate([p.links for p in parts]), np.concatenate([p.valid for p in parts]))

    def align(self, words: list[str]) -> Aligned:
        """Alignment of segments as `words` gives them, each by its parts between letters and marks; parts of earlier calls are known."""
        flat, sizes = [], array("l")
        for w in words:
            if not self.by_marks or w.isalpha():
                flat.append(" " + w)
                sizes.append(1)
            else:
                parts = BETWEEN.split(" " + w)
                flat += parts
                sizes.append(len(parts))
        if self._held > CACHED_BYTES:
            self._forget()
        known = len(self._index)
        of, sizes = np.fromiter(map(self._index.__getitem__, flat), np.int64, len(flat)), np.array(sizes, np.int64)
        del flat
        new = list(islice(self._index, known, None))
        self._held += ENTRY_BYTES * len(new) + CHARACTER_BYTES * sum(map(len, new))
        self._known.add(self._small(new))
        small = self._known
        after = np.cumsum(sizes)
        counts = _summed(small.counts[of], sizes)
        shown = [small.groups[i] for i in of.tolist()]
        groups = [shown[a] if b - a == 1 else ";".join(shown[a:b]) for a, b in zip((after - sizes).tolist(), after.tolist())]
        return Aligned(counts, groups, small.links[_stretches(small.ends[of] - small.counts[of, 3], small.counts[of, 3])],
                       _summed(~small.valid[of], sizes) == 0)


def _numbered() -> defaultdict:
    """A dictionary that gives every new key the next number."""
    return defaultdict(count().__next__)


def _pairs(spans) -> np.ndarray:
    """(begin, end) of spans."""
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many values in a row each; sums of none are zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers from each start on, so many each."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _pack(values, kind) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, kind).tobytes(), 3)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _blocks(path_a: str, path_b: str):
    def run(batches):
        # Lists of many spans and segments hold no cycles; looking for some takes a tenth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from made(batches)
        finally:
            if collecting:
                gc.enable()

    def made(batches):
        aligner = Aligner(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(pieces(batches, "_text", BLOCK_BYTES)):
            index = _numbered()
            places = []
            for text in batch.column("_text"):
                text = text.as_py()
                words = aligner.words(text) if text else []
                places.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            of = aligner.align(list(index))
            places = [p if of.valid[p].all() else p[:0] for p in places]
            # A segment that only texts without tokens have must not count.
            flat = np.concatenate([np.zeros(0, np.uint32), *places])
            times = np.bincount(flat, minlength=len(index))
            pairs, at = np.unique(of.links, return_inverse=True)
            met = np.zeros(len(pairs), np.int64)
            np.add.at(met, at, np.repeat(times, of.counts[:, 3]))
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            segments = np.concatenate([of.counts.ravel(), at])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                (first + n, pa.int64()), (_pack(pairs, "<i8"), pa.binary()), (_pack(met, "<i8"), pa.binary()),
                (_pack(segments, "<u4"), pa.binary()), (zstandard.compress("\n".join(of.groups).encode(), 3), pa.binary()),
                (_pack(ids, "<i8"), pa.binary()), (_pack([len(p) for p in places], "<i8"), pa.binary()), (_pack(flat, "<u4"), pa.binary()),
            )], [f.split()[0] for f in PACKED.split(", ")])

    return run


def _entries(batches):
    """One row per pair that a block's texts link."""
    for row in rows_of(batches):
        pairs, met = _unpack(row["pairs"], "<i8"), _unpack(row["met"], "<i8")
        kept = np.flatnonzero(met)
        for k in range(0, len(kept), 50_000):
            at = kept[k:k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[at]), pa.array(np.full(len(at), row["block"], np.int64)), pa.array(at.astype(np.int32)), pa.array(met[at])],
                ["pair", "block", "place", "met"])


def _results(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            # The counts are read as they lie; as objects of Python they would take many times the memory.
            counted = batch.column("counted").slice(i, 1).flatten()
            row = batch.drop_columns(["counted"]).slice(i, 1).to_pylist()[0]
            shown = zstandard.decompress(row["groups"]).decode().split("\n")
            segments = _unpack(row["segments"], "<u4").astype(np.int64)
            counts, at = segments[:4 * len(shown)].reshape(-1, 4), segments[4 * len(shown):]
            known = np.zeros((2, len(_unpack(row["pairs"], "<i8"))), np.int64)
            if len(counted):
                place = counted.field("place").to_numpy()
                known[0, place] = counted.field("best").to_numpy(zero_copy_only=False)
                known[1, place] = counted.field("count").to_numpy()
            per_segment = np.concatenate([counts, _summed(known[:, at].T, counts[:, 3])], 1)
            ids, sizes, places = _unpack(row["ids"], "<i8"), _unpack(row["sizes"], "<i8"), _unpack(row["places"], "<u4")
            per_text = _summed(per_segment[places], sizes)
            ends = np.cumsum(sizes)
            start, texts, held = 0, [], 0
            for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                texts.append(";".join([shown[p] for p in places[a:b].tolist()]))
                held += len(texts[-1])
                if held > BATCH_BYTES or k + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[start:k + 1]), *(pa.array(np.ascontiguousarray(c)) for c in per_text[start:k + 1].T), pa.array(texts, pa.string())],
                        [f.split()[0] for f in ROWS.split(", ")])
                    start, texts, held = k + 1, [], 0


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    A encodes blank + text, B the text, both without special tokens, whose strings are plain text. ``groups``
    has the ids of each group, ``a1,a2|b1;a3|b2``. An id pair's count is how many links of all rows have it;
    ``n_best`` are links whose count is the highest of their B id, ``count_sum`` sums the counts of a row's links.
    Texts that are null or empty, or that one of the vocabularies does not give back byte by byte, have no tokens:
    zeros and ''. Both paths are files that executors can read. Ids are whole numbers and only carried: repeated rows
    stay and count each, a null stays null. Very long texts are aligned whole. Other columns are not read. An empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    null = -(1 << 63)
    source = docs.select(F.coalesce(F.col(id).cast("bigint"), F.lit(null)).alias("_id"), text_of(text).alias("_text"))
    # Every use reads all columns, so that they share one exchange and texts are aligned once.
    packed = source.mapInArrow(_blocks(path_a, path_b), PACKED).repartition("block")
    entries = packed.mapInArrow(_entries, "pair bigint, block bigint, place int, met bigint")
    totals = entries.groupBy("pair").agg(F.sum("met").alias("count"))
    # A B id has at most one row per id of A here.
    highest = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    stats = totals.withColumn("best", F.col("count") == highest)
    back = entries.select("pair", "block", "place").join(stats, "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "count", "best")).alias("counted"))
    found = packed.join(back, "block", "left").mapInArrow(_results, ROWS)
    return found.select(F.nullif("_id", F.lit(null)).alias(id), *[c.split()[0] for c in ROWS.split(", ")[1:]])
