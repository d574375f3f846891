"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); equal root = same component.

    Each round hooks every node to its smallest neighbour (or itself).  Hooks
    only lead to smaller nodes, so they form trees; pointers are doubled until
    each node knows its tree's root, in as many steps as the logarithm of the
    deepest tree.  Then the ends of all edges are replaced by their roots, and
    edges that became loops are done.  An edge between two nodes stays an edge
    between their roots, so no connection is lost.  A node that is no root has
    a smaller neighbour; so at most half of the nodes with edges are left after
    a round, and a chain in ascending order takes one round.  Hooks and labels
    are written to the shared folder in each step.  A hot node is one partially
    aggregated minimum and a skewed join side, never a collected list.
    """
    live = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = tree_roots(materialise(both.groupBy("a").agg(F.min("b").alias("low"))
                                       .select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "hooks"))
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialise(labels.join(step, "root", "left")
                                 .select("node", F.coalesce("next", "root").alias("root")), "labels")
        end_a = roots.select(F.col("node").alias("a"), F.col("root").alias("new_a"))
        end_b = roots.select(F.col("node").alias("b"), F.col("root").alias("new_b"))
        live = materialise(live.join(end_a, "a").join(end_b, "b")
                           .select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
                           .filter("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).filter(F.lit(False))
    return labels


def tree_roots(hooks: DataFrame) -> DataFrame:
    """(node, root) of stored trees (node, root) of pointers to smaller nodes; a root points to itself."""
    while True:
        ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        doubled = materialise(hooks.join(ahead, "root").select("node", "root", "next"), "hooks")
        moved = not doubled.filter("next <> root").isEmpty()
        hooks = doubled.select("node", F.col("next").alias("root"))
        if not moved:
            return hooks
