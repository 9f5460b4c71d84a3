"""Weighted PageRank by repeated join and aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.columns import share_sum
from spreadrank.operators.graph import Graph, out_totals
from spreadrank.operators.skew import hot_keys
from spreadrank.params import DEFAULTS, SkewLimits
from spreadrank.storage import checkpoint_hashed, fixed_plans, materialize, new_folder, partitions_for


class NotConverged(RuntimeError):
    pass


@dataclass(frozen=True)
class Layout:
    """The edges of ordinary sources, hashed by source, and those of the few hot ones."""

    usual: DataFrame
    hot: DataFrame | None
    hot_sources: DataFrame | None
    parts: int


def lay_out(graph: Graph, limits: SkewLimits) -> Layout:
    """Shuffle the edges once for all rounds; hot sources are looked for once as well."""
    spark = graph.edges.sparkSession
    parts = partitions_for(spark, graph.n_edges, 60)
    fixed = fixed_plans(spark)
    edges = graph.edges_in(fixed)
    if graph.n_edges <= limits.min_rows:
        return Layout(checkpoint_hashed(edges, parts, ["src"]), None, None, parts)
    path = new_folder(spark, "hot")
    hot = materialize(hot_keys(graph.edges, ["src"], graph.n_edges, limits).select("src"), "hot", path)
    usual = edges.join(F.broadcast(fixed.read.schema(hot.schema).parquet(path)), "src", "left_anti")
    heavy = materialize(graph.edges.join(F.broadcast(hot), "src", "left_semi"), "heavy")
    return Layout(checkpoint_hashed(usual, parts, ["src"]), heavy, hot, parts)


def compute_pagerank(
    graph: Graph,
    damping: float = DEFAULTS.damping,
    max_iter: int = DEFAULTS.pagerank_max_iter,
    tol: float = DEFAULTS.pagerank_tol,
    rounds: int | None = None,
    limits: SkewLimits = DEFAULTS.skew,
    abs_tol: float | None = None,
) -> DataFrame:
    """``(id, pagerank)``.

    Starts at 1/N; a node hands ``damping`` of its rank to its successors in proportion to edge
    weight, and nodes without out-edges hand theirs to all nodes. Stops when the ranks together
    change by less than ``abs_tol`` or, without one, ``N * tol``, and raises after ``max_iter`` rounds. With
    ``rounds`` given, exactly that many are run. The first round changes the ranks by 2 * ``damping`` at
    most, so with the default tolerance it is the last one from 300,000 nodes on.

    The edges are shuffled by source once; a round shuffles the ranks, by source, and what flows into a
    node, summed before the shuffle by target. Hot sources are joined map-side. Sums are of whole units, so ranks
    do not depend on the order of the rows. Two numbers per round reach the driver.
    """
    n = graph.n_nodes
    spark = graph.nodes.sparkSession
    if n == 0:
        return spark.createDataFrame([], "id string, pagerank double")
    enough = n * tol if abs_tol is None else abs_tol

    layout = lay_out(graph, limits)
    totals = out_totals(graph.edges).select(F.col("src").alias("id"), "out_weight")
    ranks = graph.nodes.join(totals, "id", "left").select(
        "id",
        F.when(F.col("out_weight") > 0, F.col("out_weight")).alias("out_weight"),
        F.lit(1.0 / n).alias("rank"),
        F.lit(0.0).alias("change"),
    )
    ranks = materialize(ranks, "rank")
    for step in range(rounds if rounds is not None else max_iter):
        dangling, change = ranks.agg(
            F.coalesce(share_sum(F.when(F.col("out_weight").isNull(), F.col("rank"))), F.lit(0.0)),
            share_sum(F.col("change")),
        ).first()
        if rounds is None and step and change < enough:
            break
        ranks = materialize(_round(graph, layout, ranks, damping, dangling / n), "rank")
    else:
        # The last allowed round may itself have met the tolerance.
        if rounds is None and not ranks.agg(share_sum(F.col("change"))).first()[0] < enough:
            raise NotConverged(f"PageRank did not converge in {max_iter} rounds")
    return ranks.select("id", F.col("rank").alias("pagerank"))


def inflows(layout: Layout, ranks: DataFrame) -> DataFrame:
    """``(id, inflow)``: what flows into each node that has an in-edge."""
    units = ranks.filter(F.col("out_weight").isNotNull()).select(
        F.col("id").alias("src"), (F.col("rank") / F.col("out_weight")).alias("unit")
    )
    met = layout.usual.join(units.repartition(layout.parts, "src").hint("merge"), "src")
    if layout.hot is not None:
        few = units.join(F.broadcast(layout.hot_sources), "src", "left_semi")
        met = met.unionByName(layout.hot.join(F.broadcast(few), "src"))
    return met.groupBy(F.col("dst").alias("id")).agg(
        share_sum(F.col("unit") * F.col("weight")).alias("inflow")
    )


def _round(graph: Graph, layout: Layout, ranks: DataFrame, damping, shared) -> DataFrame:
    new = damping * (F.coalesce("inflow", F.lit(0.0)) + F.lit(shared)) + F.lit((1.0 - damping) / graph.n_nodes)
    return (
        ranks.join(inflows(layout, ranks), "id", "left")
        .withColumn("new", new)
        .select(
            "id",
            "out_weight",
            F.col("new").alias("rank"),
            F.abs(F.col("new") - F.col("rank")).alias("change"),
        )
    )
