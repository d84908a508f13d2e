"""Connected components of an undirected graph given as two long columns, in Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.llm.common import written


def _jump(parent: DataFrame) -> DataFrame:
    """Follow parents until each node points at its root (a node without a row is its own root)."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parent = written(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "roots")
        if not parent.filter("moved").limit(1).count():
            return parent.select("node", "parent")
        parent = parent.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge except the roots themselves; root is the smallest node.

    Each round hangs every node that has a smaller neighbour below its smallest one, follows the
    chains and contracts the edges to the roots, until no edge is left.  Every table of
    a round is written, so a lost executor costs one step; a node with many edges is pre-aggregated.
    """
    left = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    root = None
    while left.limit(1).count():
        hung = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        step = _jump(hung)
        if root is None:
            root = step
        else:
            moved = step.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            root = root.join(moved, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
            root = written(root.unionByName(step), "roots")
        a = step.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        ends = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    if root is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.select("node", F.col("parent").alias("root"))
