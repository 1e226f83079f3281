"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct five-word shingles. Its signature has 36 symbols of 16 bits,
each taken from the minimum of one hash function over the set. Documents are linked when their sets
share a given part of their union, 85 % or 80 %. A signature is cut into nine chunks of four symbols,
and every chunk is looked up four times, each time with another symbol left open. By the pigeonhole
principle all pairs that differ in at most 17 symbols meet under a key. Pairs that meet and differ in at most
`symbols_apart` symbols, never more than those 17, are confirmed on their full sets. That distance follows from
the similarity: 14 at 85 % and 17 at 80 %, where a pair at the threshold is lost about once in 9,600 and 18,000.

Texts with equal word sequences have equal sets and are first made one class. What meets is never listed in pairs.
Groups of near copies are joined first: in a round, a class looks at the LEADERS smallest classes of each key, passes
those of its own component and those that are too far apart, and is tested with the smallest others that its keys
then show, as one link is enough; after each round components are joined, and rounds go on with more tests for a class while
tests find links. Then keys that still have several components are swept: the classes outside of a key's largest
component, SWEPT at a time, meet those of other components in tasks of GROUP_ROWS classes, each pair under the first key that
it shares. What tasks give out are links alone, and of these no more than join their components. Two classes of one component are never tested.
"""

import hashlib
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm import shingles
from logfold.llm.arrow import pieces
from logfold.llm.common import beside, forget, join_groups, small_batches, stored, text_of
from logfold.llm.components import connected_components

SIMILARITY_PERCENT = 85
# Symbols in which all pairs may differ that the index is sure to bring together.
SURE_APART = 2 * (shingles.SYMBOLS // shingles.CHUNK) - 1
# Share of pairs at the threshold whose signatures may differ by more.
LOSS = 1.1e-4
# Classes of a key that the others look at in the rounds that join groups of near copies, and tests of a class in them.
LEADERS = 8
TESTS = (1, 2, 4, 8, 16)
# Classes of a key that lead in a sweep, and those that one task compares them with.
SWEPT, GROUP_ROWS = 512, 512
# Rounds go on while so many of the tests find a link.
WORTH = 0.2
RESULTS = ["n_shingles", "component_id", "kept"]


def lost(percent: int, apart: int) -> float:
    """Share of pairs of that similarity whose signatures differ in more than ``apart`` symbols."""
    same, n = percent / 100, shingles.SYMBOLS
    return sum(comb(n, k) * (1 - same) ** k * same ** (n - k) for k in range(apart + 1, n + 1))


@cache
def symbols_apart(percent: int) -> int:
    """The smallest distance of signatures with which no more than LOSS is lost at the threshold; all pairs within it meet."""
    for apart in range(SURE_APART + 1):
        if lost(percent, apart) <= LOSS:
            return apart
    raise ValueError(f"the index loses more than {LOSS} of the pairs with a similarity of {percent} %")


def _texts(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _signed(batches):
    """(id, words, n_shingles, signature) of every text; ``words`` is the digest of the word sequence, null if there is none."""
    for batch in pieces(batches, "_text"):
        texts = _texts(batch.column("_text"))
        sets = shingles.shingle_sets(texts)
        signs = shingles.signatures(sets)
        words = [hashlib.sha256(b" ".join(t.lower().split())).digest() if len(s) else None for t, s in zip(texts, sets)]
        yield pa.RecordBatch.from_arrays([
            batch.column("_id"), pa.array(words, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array(list(signs.view(np.int16)), pa.list_(pa.int16())),
        ], ["_id", "words", "n_shingles", "signature"])


def _indexed(batches):
    for batch in batches:
        signs = np.asarray(batch.column("signature").flatten()).view(np.uint16).reshape(-1, shingles.SYMBOLS)
        keys = shingles.index_keys(signs)
        ids = np.repeat(np.asarray(batch.column("class_id")), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "class_id"])


def _sets(batches):
    """(class_id, shingles) of texts: the full sets, in order, as bytes."""
    for batch in pieces(batches, "text"):
        sets = shingles.shingle_sets(_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["class_id", "shingles"])


def _confirmed(percent: int):
    """Pairs whose full sets are similar enough."""
    def run(batches):
        for batch in pieces(pieces(batches, "set_a"), "set_b"):
            linked = [
                shingles.similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(batch.column("set_a"), batch.column("set_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked.

    A class is ``b`` of few pairs of a round; it can be ``a`` of any number.
    """
    one, two = (sets.select(F.col("class_id").alias(side), F.col("shingles").alias(f"set_{side}")) for side in "ab")
    sizes = near.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    read = join_groups(near.join(two, "b"), sizes.join(one, "a"), "a", "b", "inner", sizes).drop("_n")
    return stored(read.mapInArrow(_confirmed(percent), "a bigint, b bigint"), "links")


def _components_of(rows: DataFrame, components: DataFrame | None, column: str = "class_id") -> DataFrame:
    """Rows with the component of their class, itself if it has no links."""
    if components is None:
        return rows.withColumn("component", F.col(column))
    joined = rows.join(components.withColumnRenamed("node", column), column, "left")
    return joined.withColumn("component", F.coalesce("component", column))


def _opened(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    """Rows with component and _n, of the keys that have several components."""
    rows = _components_of(rows.drop("component", "_n"), components)
    keys = stored(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min("component").alias("_lo"), F.max("component").alias("_hi"),
    ).filter("_lo <> _hi").select("key", "_n"), "several")
    opened = stored(join_groups(rows, keys, "key", "class_id", "inner"), "open")
    forget(keys)
    return opened


def _beside_leaders(rows: DataFrame, leaders: DataFrame, near, name: str) -> DataFrame:
    """``near(row, first)`` of every row, ``first`` being the leaders of its key in order; stored."""
    groups = stored(leaders.groupBy("key").agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("class_id", "signature", "component"))).alias("first")), "leaders")
    found = stored(near(join_groups(rows.drop("_n"), groups, "key", "class_id", "inner")), name)
    forget(groups)
    return found


def _may_be_linked(leader: Column, most_apart: int) -> Column:
    """True for leaders of other components within the distance."""
    differs = F.filter(F.zip_with(leader["signature"], "signature", lambda x, y: x != y), lambda d: d)
    return (leader["component"] != F.col("component")) & (F.size(differs) <= most_apart)


def _smallest_near(opened: DataFrame, tried: DataFrame | None, most_apart: int, tests: int) -> DataFrame:
    """Pairs (a, b): every class b with the smallest others that its keys show it first, beyond those it was tested with."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("class_id"))
    leaders = opened.withColumn("_place", place).filter(F.col("_place") <= LEADERS)
    rows = opened.withColumn("tried", F.lit(None).cast("bigint")) if tried is None else opened.join(tried, "class_id", "left")

    def first_near(led):
        later = lambda f: (f["class_id"] < F.col("class_id")) & (F.col("tried").isNull() | (f["class_id"] > F.col("tried")))
        near = F.filter("first", lambda f: later(f) & _may_be_linked(f, most_apart))
        return led.select("class_id", F.get(near, F.lit(0))["class_id"].alias("a")).filter("a is not null")

    shown = _beside_leaders(rows, leaders, first_near, "shown")
    # A class has a few keys, so this is a short list.
    chosen = shown.groupBy(F.col("class_id").alias("b")).agg(F.slice(F.sort_array(F.collect_set("a")), 1, tests).alias("near"))
    pairs = stored(chosen.select(F.explode("near").alias("a"), "b"), "near")
    forget(shown)
    return pairs


def _ranked(opened: DataFrame) -> DataFrame:
    """Rows with ``place``, their number among those of their key outside of its largest component; null within it."""
    counts = opened.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_c"))
    main = counts.groupBy("key").agg(F.max("_c").alias("_n"), F.max_by("component", F.struct("_c", "component")).alias("main"))
    sizes = stored(opened.groupBy("key").agg(F.max("_n").alias("_n")).join(main.drop("_n"), "key"), "main")
    rows = join_groups(opened.drop("_n"), sizes, "key", "class_id", "inner")
    outside = F.col("component") != F.col("main")
    place = F.row_number().over(Window.partitionBy("key", "_outside").orderBy("class_id"))
    rows = rows.withColumn("_outside", outside).withColumn("place", F.when(F.col("_outside"), place))
    ranked = stored(rows.select("key", "class_id", "signature", "place"), "ranked")
    forget(sizes)
    return ranked


def _meeting_keys(differs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One of the index's keys under which pairs meet, by their differing symbols: the next one from a number on that spreads pairs over keys."""
    parts = differs.reshape(len(differs), -1, shingles.CHUNK)
    wrong = parts.sum(2, keepdims=True)
    # A key leaves one symbol of its chunk open; all others are equal.
    meet = (wrong - parts == 0).reshape(len(differs), -1)
    after = (np.arange(meet.shape[1]) - start[:, None]) % meet.shape[1]
    return np.where(meet, after, meet.shape[1]).argmin(1)


class _Leaders:
    """Classes of a key with their sets, and for every shingle which of them have it."""

    def __init__(self, ids, signs, sets):
        self.ids, self.signs, self.sizes = ids, signs, np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self._flat, self._owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each of them has in common with a set."""
        low, high = (np.searchsorted(self._flat, own, side) for side in ("left", "right"))
        n = high - low
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.bincount(self._owner[at], minlength=len(self.ids))


class _Joined:
    """Components of a task's classes, and which of them links have joined so far: equal numbers in ``of``."""

    def __init__(self, components):
        self._known = np.unique(np.asarray(components))
        self.of = np.arange(len(self._known))

    def places(self, components: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._known, components)

    def join(self, x: int, y: int) -> None:
        self.of[self.of == self.of[y]] = self.of[x]


def _columns(table: pa.Table) -> dict[int, tuple]:
    """By key: class ids in order, their components, signatures, sets (if the table has them), and whether each is of the key's largest component."""
    if not table.num_rows:
        return {}
    table = table.sort_by([("key", "ascending"), ("class_id", "ascending")])
    signs = np.asarray(table.column("signature").combine_chunks().flatten()).view(np.uint16).reshape(-1, shingles.SYMBOLS)
    keys, ids, of = (np.asarray(table.column(c)) for c in ("key", "class_id", "component"))
    main = table.column("place").is_null().to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")] if "shingles" in table.column_names else []
    cuts = np.append(np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)), len(keys)).tolist()
    return {int(keys[a]): (ids[a:b], of[a:b], signs[a:b], sets[a:b], main[a:b]) for a, b in zip(cuts[:-1], cuts[1:])}


def _met(rows: pa.Table, leading: pa.Table, most_apart: int):
    """(key, row, leaders) by place among the key's: which leaders a class is to be compared with under this key."""
    led_of_key = _columns(leading)
    for key, row in (_columns(rows) if led_of_key else {}).items():
        if key not in led_of_key:
            continue
        (ids, of, signs, _, main), lead = row, led_of_key[key]
        led, led_of, led_signs = lead[:3]
        here = key >> (shingles.SYMBOL_BITS * (shingles.CHUNK - 1))
        for i, own in enumerate(ids.tolist()):
            # Of two classes outside of the largest component, the smaller one leads.
            at = np.flatnonzero((led_of != of[i]) & (main[i] | (led < own)))
            differs = led_signs[at] != signs[i]
            near = differs.sum(1) <= most_apart
            at, differs = at[near], differs[near]
            at = at[_meeting_keys(differs, (led[at] ^ own) % shingles.SYMBOLS) == here] if len(at) else at
            if len(at):
                yield key, row, lead, i, at


def _compared_in(most_apart: int):
    """(key, class_id) of the classes that are to be compared with a leader, or lead."""
    def run(_, rows, leading):
        found = {(key, int(x)) for key, row, lead, i, at in _met(rows, leading, most_apart) for x in (row[0][i], *lead[0][at])}
        return pa.table({c: pa.array([x[n] for x in found], pa.int64()) for n, c in enumerate(("key", "class_id"))})

    return run


def _linked_in(most_apart: int, percent: int):
    """Links between the classes of keys and their leaders, fewer than the components that the task has: those that links already join are passed."""
    def run(_, rows, leading):
        out, index = [], (None, None)
        joined = _Joined(pa.chunked_array([*rows.column("component").chunks, *leading.column("component").chunks], pa.int64()))
        for key, row, lead, i, at in _met(rows, leading, most_apart):
            if index[0] != key:
                index = key, _Leaders(lead[0], lead[2], lead[3]), joined.places(row[1]), joined.places(lead[1])
            _, leaders, row_of, led_of = index
            own = row[3][i]
            at = at[joined.of[led_of[at]] != joined.of[row_of[i]]]
            if not len(at):
                continue
            both = leaders.shared(own)[at]
            at = at[100 * both >= percent * (leaders.sizes[at] + len(own) - both)]
            # A link to any member of a component is enough.
            for k in at[np.unique(joined.of[led_of[at]], return_index=True)[1]].tolist():
                out.append((min(int(row[0][i]), int(leaders.ids[k])), max(int(row[0][i]), int(leaders.ids[k]))))
                joined.join(row_of[i], led_of[k])
        return pa.table({c: pa.array([pair[n] for pair in out], pa.int64()) for n, c in enumerate("ab")})

    return run


def _swept(opened: DataFrame, sets: DataFrame, first: int, most_apart: int, percent: int) -> DataFrame:
    """Links (a, b) of the next leaders by place with all other classes of their keys.

    Large keys are dealt to several tasks, small ones share one.
    """
    tasks = F.ceil(F.col("_n") / GROUP_ROWS).cast("int")
    groups = max(1, opened.count() // GROUP_ROWS)
    opened = opened.withColumn("slot", F.when(tasks > 1, F.col("key")).otherwise(-1 - F.pmod(F.xxhash64("key"), F.lit(groups))))
    columns = ["slot", "part", "key", "class_id", "component", "signature", "place"]

    def both(rows, more=()):
        leaders = rows.filter((F.col("place") > first) & (F.col("place") <= first + SWEPT))
        leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("class_id"), tasks).cast("int")).select(*columns, *more)
        # The same rows on both sides are told apart by new names for the columns.
        leaders = leaders.select([F.col(c).alias(c) for c in [*columns, *more]])
        return rows.groupBy("slot", "part").cogroup(leaders.groupBy("slot", "part"))

    # Signatures alone tell which classes will be compared; their sets follow.
    compared = stored(both(opened).applyInArrow(_compared_in(most_apart), "key bigint, class_id bigint").distinct(), "compared")
    rows = opened.join(compared, ["key", "class_id"], "left_semi").join(sets, "class_id")
    links = stored(both(rows, ["shingles"]).applyInArrow(_linked_in(most_apart, percent), "a bigint, b bigint"), "links")
    forget(compared)
    return links


def _joined(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: those of the components that the links join, and what follows for their members."""
    if links.isEmpty():
        return components
    if components is None:
        return connected_components(links)
    ends = _components_of(_components_of(links, components, "a").select(F.col("component").alias("a"), "b"), components, "b")
    top = connected_components(ends.select("a", F.col("component").alias("b")))
    moved = _components_of(components.select("node", F.col("component").alias("was")), top, "was").select("node", "component")
    joined = stored(moved.unionByName(top.join(components, "node", "left_anti")), "components")
    forget(components, top)
    return joined


def near_components(docs: DataFrame, id: str, text: str, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(_id, n_shingles, component_id) of every row with an id."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id).cast("bigint").alias("_id"), text_of(text).alias("_text")).filter("_id is not null")
    signed = stored(source.mapInArrow(_signed, "_id bigint, words binary, n_shingles bigint, signature array<smallint>"), "signed")
    groups = signed.filter("words is not null").groupBy("words").agg(
        F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("_n"), F.min("signature").alias("signature"))
    classes = stored(groups, "classes")
    known = join_groups(signed.drop("signature"), classes.select("words", "_n", "class_id"), "words", "_id")
    known = stored(known.select("_id", "n_shingles", F.coalesce("class_id", "_id").alias("class_id")), "known")
    forget(signed)
    # Rows that repeat an id are one document, so the classes of its texts are one component.
    own = known.groupBy("_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_hi")).filter("a <> _hi").select("_id", "a")
    same = stored(known.join(own, "_id").select("a", F.col("class_id").alias("b")).filter("a <> b").distinct(), "same")
    components = _joined(None, same)
    forget(same)

    # A class has as many keys as the index; signatures go only to those that are open.
    index = classes.select("class_id", "signature").mapInArrow(_indexed, "key bigint, class_id bigint").distinct()
    opened = _opened(index, components)
    rows = stored(opened.select("key", "class_id").join(classes.select("class_id", "signature"), "class_id"), "keys")
    forget(opened, classes)
    texts = source.withColumnRenamed("_id", "class_id").join(rows.select("class_id").distinct(), "class_id", "left_semi")
    # Rows that repeat an id can have several texts, and so sets: links of any are links of the document.
    sets = stored(texts.select("class_id", F.col("_text").alias("text")).mapInArrow(_sets, "class_id bigint, shingles binary")
                  .distinct(), "sets")
    apart, tried = symbols_apart(percent), None
    for tests in TESTS:
        opened = _opened(rows, components)
        forget(rows)
        rows = opened
        near = _smallest_near(opened, tried, apart, tests)
        number = near.count()
        if not number:
            forget(near)
            break
        links = _links(near, sets, percent)
        enough = links.count() >= WORTH * number
        components = _joined(components, links)
        if tried is not None:
            forget(tried)
        # What is left out here is found by the sweeps.
        tried = stored(near.groupBy(F.col("b").alias("class_id")).agg(F.max("a").alias("tried")), "tried")
        forget(near, links)
        if not enough:
            break

    opened = _opened(rows, components)
    forget(rows)
    rows, first = _ranked(opened), 0
    forget(opened)
    while True:
        opened = _opened(rows.filter(F.col("place").isNull() | (F.col("place") > first)), components)
        if opened.filter(F.col("place") > first).isEmpty():
            break
        links = _swept(opened, sets, first, apart, percent)
        components = _joined(components, links)
        forget(opened, links)
        first += SWEPT
    forget(opened, rows, sets)

    found = _components_of(known, components)
    return found.select("_id", "n_shingles", F.col("component").alias("component_id"))


def minhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                  percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Every row with ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept``.

    Texts are linked when their sets share ``percent`` of their union; 80 is about the least that the index allows.
    Ids are whole numbers. A text without words has no shingles and no links. Rows with equal ids are
    one document with the links of each, to which they are joined. Texts of any length count whole. Rows with a null id are not compared and are kept, with null results.
    Given columns with the name of a result are replaced. An empty table gives no rows.
    """
    given = docs.columns if carry is None else carry
    found = near_components(docs, id, text, percent).groupBy(F.col("_id").alias("_of")).agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.col(id).cast("bigint").alias("_id"))
    rows = rows.join(found, F.col("_id") == F.col("_of"), "left")
    rows = rows.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))
    return beside(rows, "row", given, RESULTS)
