"""Connected components of a graph of any size: hook every node to its smallest neighbour, jump to the roots, contract."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import forget, stored


def _jumped(links: DataFrame) -> DataFrame:
    """Parents replaced by roots (columns node, parent); paths halve in every pass. ``links`` is stored, and is deleted once replaced.

    A parent of very many nodes is a skewed key of a shuffle join, which adaptive execution splits.
    """
    while True:
        heads = links.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        jumped = stored(links.join(heads, "parent", "left").select(
            "node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "jump")
        forget(links)
        if jumped.filter("moved").isEmpty():
            return jumped
        links = jumped


def _renamed(rows: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root where it has one."""
    roots = links.select(F.col("node").alias(column), F.col("parent").alias("_root"))
    return rows.join(roots, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not the smallest of its component.

    No edges give no rows. Loops and repeated edges count once; edges with a null end count for nothing.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.filter("a is not null and b is not null and a <> b").select(lo.alias("lo"), hi.alias("hi"))
    known, left = None, None
    while left is None or not left.isEmpty():
        rest = edges if left is None else left
        links = _jumped(stored(rest.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks"))
        roots = links.select("node", "parent")
        moved = _renamed(_renamed(rest, roots, "hi"), roots, "lo").filter("lo <> hi")
        after = stored(moved.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges")
        if known is None:
            known = links
        else:
            merged = stored(_renamed(known.select("node", "parent"), roots, "parent").unionByName(roots), "known")
            forget(known, links)
            known = merged
        if left is not None:
            forget(left)
        left = after
    forget(left)
    named = known.select("node", F.col("parent").alias("component"))
    named._stored_at = known._stored_at
    return named
