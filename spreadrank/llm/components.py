"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.storage import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` to the end, doubling the step each time; parents are smaller than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
        )
        jumped = materialize(jumped, "jumped")
        parents = jumped.select("node", "parent")
        if not jumped.filter("moved").limit(1).count():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node with an edge that is not its component's least node, the root.

    ``edges`` has columns ``a`` and ``b``. Each round hangs every node below its least neighbour, an aggregate
    that is combined before the shuffle, follows these links to the end, and replaces the ends of the
    edges by what they hang below. Every tree loses all nodes but its root, so the number of rounds is
    logarithmic, and so is the number of steps in a round.
    """
    found: DataFrame | None = None
    rest = edges.select("a", "b").filter("a != b")
    while True:
        rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if not rest.limit(1).count():
            break
        # Each node's least neighbour, where that is smaller than itself.
        parents = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = _roots(materialize(parents, "parents"))
        first = roots.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        second = roots.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        moved = rest.join(first, "a", "left").join(second, "b", "left")
        rest = moved.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b")
        roots = roots.withColumnRenamed("parent", "root")
        if found is None:
            found = roots
        else:
            newer = roots.select(F.col("node").alias("root"), F.col("root").alias("newer"))
            lifted = found.join(newer, "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
            found = materialize(lifted.unionByName(roots), "components")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return found
