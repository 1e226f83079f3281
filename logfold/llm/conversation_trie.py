"""The prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt: those of one group begin with the first turns of the group's own conversation.
Equal rebuilt ones become one sequence with a weight and a list of its ends. A sequence that an anti-join
finds among the proper prefixes of others is no leaf. Every distinct prefix is a node; weights of the
sequences that begin with it add up.

A prefix is known by 128 bits of sums over its turns, each hashed together with its place. Sums run along a
conversation in buckets (`plans.scan`), so a conversation of any length spreads over tasks and no list of turns is gathered.
What a subtree saves is added up along leaves: each node is booked on the smallest leaf below it, and a node's sum
is that of what its leaves have booked from its depth on. Rows are those of distinct sequences, never node times ancestor.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import WORD, join_groups, small_batches, stored
from logfold.plans.scan import BITS, BUCKET, attach, carry, in_bucket

# Conversations of a group share the first turns of its own conversation, fewer than HEADS.
GROUP, HEADS = 20, 4
# Conversations whose ids are joined to one text at most, before texts are hashed in order.
ENDS_BITS = 12
LANES = ["_a", "_b1", "_c", "_e"]
NODE = "node struct<a:bigint,b:bigint>"


def _head_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def _spread(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.withColumn(BUCKET, bucket).repartition("conv_id", BUCKET)


def _placed(conversations: DataFrame, columns: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """Turns with their place ``_pos`` from 1 in their conversation, and (conv_id, _b) of all buckets; null turns come first, ties by content."""
    first = F.lit(-(1 << 62))
    rows = _spread(conversations, F.coalesce(F.shiftright("turn", bits), first))
    counts = rows.groupBy("conv_id", BUCKET).agg(F.count(F.lit(1)).alias("rows"))
    offsets = carry(counts, ["conv_id"], {"rows": "sum"}, bits).select("conv_id", BUCKET, "before_rows")
    number = F.row_number().over(in_bucket(["conv_id"], F.asc_nulls_first("turn"), "_t1", "_t2"))
    found = attach(rows, offsets, ["conv_id"]).withColumn("_pos", (number + F.coalesce("before_rows", F.lit(0))).cast("bigint"))
    return found.select("conv_id", BUCKET, "_pos", "_t1", "_t2", *columns), counts


def rebuilt(conversations: DataFrame, carry_columns: list[str] = ["role", "text"], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, depth, hashes, given columns), and (conv_id) of all, turnless ones included."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), whole.alias("_sha"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), role.alias("role"), text.alias("text"),
    ).withColumns({"_t1": F.xxhash64("_sha"), "_t2": F.xxhash64(F.lit(1), "_sha")})
    columns = ["words", *carry_columns]
    turns = turns.select("conv_id", "turn", "_t1", "_t2", *columns)

    own, counts = _placed(turns, columns, bits)
    # Few turns of few conversations are passed on.
    lent, _ = _placed(turns.filter(F.col("conv_id") % GROUP == 0), columns, bits)
    turn = F.struct("_pos", "_t1", "_t2", *columns)
    lent = lent.filter(F.col("_pos") < HEADS).groupBy(F.col("conv_id").alias("_base")).agg(F.sort_array(F.collect_list(turn)).alias("_lent"))
    every = counts.select("conv_id").distinct()
    heads = every.withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP).join(lent, "_base", "left").select(
        "conv_id", F.when(F.col("_lent").isNotNull(), F.slice("_lent", 1, _head_turns(F.col("conv_id")).cast("int"))).alias("_head"))
    taken = heads.select("conv_id", F.coalesce(F.size("_head"), F.lit(0)).alias("_taken"))
    shift = counts.select("conv_id", BUCKET).join(taken, "conv_id")
    skipped = _head_turns(F.col("conv_id"))
    rest = attach(own, shift, ["conv_id"]).filter(F.col("_pos") > skipped).select(
        "conv_id", (F.col("_pos") - skipped + F.greatest(F.col("_taken"), F.lit(0))).alias("depth"), "_t1", "_t2", *columns)
    first = heads.select("conv_id", F.explode("_head").alias("_x")).select(
        "conv_id", F.col("_x._pos").alias("depth"), "_x._t1", "_x._t2", *[f"_x.{c}" for c in columns])
    return rest.unionByName(first), every


def _node(lanes: list[Column], depth: Column) -> Column:
    return F.struct(F.xxhash64(*lanes, depth).alias("a"), F.xxhash64(F.lit(1), depth, *reversed(lanes)).alias("b"))


def _sequences(conversations: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(prefixes, wholes): a row per depth of each distinct sequence from its smallest conversation, and all conversations with their end."""
    turns, every = rebuilt(conversations, [], bits)
    low, lane = F.lit((1 << 32) - 1), F.xxhash64("depth", "_t1", "_t2")
    other = F.xxhash64("_t2", "depth", "_t1")
    values = dict(zip(LANES, (lane.bitwiseAND(low), F.shiftrightunsigned(lane, 32), other.bitwiseAND(low), F.shiftrightunsigned(other, 32))))
    rows = turns.select("conv_id", "depth", "words", *[v.alias(c) for c, v in values.items()])
    rows = _spread(rows, F.shiftright("depth", bits))
    totals = rows.groupBy("conv_id", BUCKET).agg(*[F.sum(c).alias(c) for c in LANES], F.max("depth").alias("depth"))
    sums = totals.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in LANES], F.max("depth").alias("depth"))
    zero = F.lit(0).cast("bigint")
    wholes = every.join(sums, "conv_id", "left").select("conv_id", F.coalesce("depth", zero).alias("depth"), *[F.coalesce(c, zero).alias(c) for c in LANES])
    wholes = stored(wholes.select("conv_id", "depth", _node([F.col(c) for c in LANES], F.col("depth")).alias("node")), "wholes")

    # A sequence goes on with the turns of its smallest conversation; those of the others are left behind.
    sequences = wholes.groupBy("node", F.col("depth").alias("last")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    before = carry(totals, ["conv_id"], {c: "sum" for c in LANES}, bits).select("conv_id", BUCKET, *[f"before_{c}" for c in LANES])
    before = before.join(sequences.select("conv_id", "last", "weight"), "conv_id")
    along = in_bucket(["conv_id"], "depth")
    rows = attach(rows, before, ["conv_id"]).filter("weight is not null")
    rows = rows.withColumns({f"_sum{c}": F.sum(c).over(along) + F.coalesce(f"before_{c}", zero) for c in LANES})
    here = _node([F.col(f"_sum{c}") for c in LANES], F.col("depth"))
    above = _node([F.col(f"_sum{c}") - F.col(c) for c in LANES], F.col("depth") - 1)
    prefixes = rows.select("conv_id", "depth", here.alias("node"), above.alias("parent"), "words", "weight", "last")
    roots = sequences.select("conv_id", zero.alias("depth"), _node([zero] * len(LANES), zero).alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"),
                             zero.alias("words"), "weight", "last")
    return stored(prefixes.unionByName(roots), "prefixes"), wholes


def _digests(batches):
    """(node, ends_sha256) of texts of ids (node, part, ids) that come in order; a node's texts are hashed one after the other."""
    last, digest = None, None
    for batch in batches:
        done = []
        nodes = zip(*(batch.column("node").field(f).to_pylist() for f in "ab"))
        for node, ids in zip(nodes, batch.column("ids")):
            text = ids.as_py().encode()
            if node == last:
                digest.update(b"," + text)
                continue
            if last is not None:
                done.append((last, digest.hexdigest()))
            last, digest = node, hashlib.sha256(text)
        yield _digest_rows(done)
    if last is not None:
        yield _digest_rows([(last, digest.hexdigest())])


def _digest_rows(done) -> pa.RecordBatch:
    nodes = pa.StructArray.from_arrays([pa.array([n[k] for n, _ in done], pa.int64()) for k in (0, 1)], ["a", "b"])
    return pa.RecordBatch.from_arrays([nodes, pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])


def _ends(wholes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    parts = wholes.groupBy("node", F.shiftright("conv_id", ENDS_BITS).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = parts.repartition("node").sortWithinPartitions("node", "part")
    return ordered.mapInArrow(_digests, f"{NODE}, ends_sha256 string")


def _saved(leaf_rows: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """(node, saved_tokens): what the nodes of its subtree save."""
    booked = nodes.filter("n_convs > 1 and words > 0").select(
        F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("_x"))
    zero = F.lit(0).cast("bigint")
    rows = leaf_rows.select("conv_id", "depth", "node").join(booked, ["conv_id", "depth"], "left").withColumn("_x", F.coalesce("_x", zero))
    # Depths fall along the scan, so that sums run from the leaf to the root.
    rows = _spread(rows, F.shiftright(-F.col("depth"), bits))
    totals = rows.groupBy("conv_id", BUCKET).agg(F.sum("_x").alias("_x"))
    before = carry(totals, ["conv_id"], {"_x": "sum"}, bits).select("conv_id", BUCKET, "before__x")
    below = F.sum("_x").over(in_bucket(["conv_id"], F.desc("depth"))) + F.coalesce("before__x", zero)
    return attach(rows, before, ["conv_id"]).withColumn("_below", below).groupBy("node").agg(F.sum("_below").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns go by ``turn``, null first,
    ties by content; null role or text is empty. Rows without conv_id belong to no conversation. Repeated rows are
    turns of their own. Conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own turns
    after its first h, h being crc32 of the decimal c, modulo 4; % is that of SQL. A node is named by its smallest
    conversation and its depth; the root has depth 0 and no parent. No conversations give no rows. ``ends_sha256`` is that
    of the comma-joined ids of conversations that end there. Equality of prefixes is that of 128 bits.
    """
    small_batches(conversations.sparkSession)
    prefixes, wholes = _sequences(conversations, bits)
    ends = prefixes.filter("depth = last")
    proper = prefixes.filter("depth < last").select("node").distinct()
    leaves = ends.join(proper, "node", "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    rows = stored(prefixes.join(leaves, "conv_id", "left"), "rows")
    nodes = stored(rows.groupBy("node", "depth").agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), F.min("parent").alias("parent"),
        F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"),
        F.coalesce(F.sum(F.when(F.col("depth") == F.col("last"), F.col("weight"))), F.lit(0)).alias("n_ends"),
    ), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # A node with a large share of all nodes as its children is dealt out.
    named = nodes.select("node", F.col("conv_id").alias("parent_conv_id")).join(children, "node").select(
        F.col("node").alias("parent"), F.col("n_children").alias("_n"), "parent_conv_id")
    found = join_groups(nodes, named, "parent", "node").drop("_n")
    found = found.join(children, "node", "left").join(_saved(rows.filter("leaf"), nodes, bits), "node", "left").join(_ends(wholes), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "n_ends",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
