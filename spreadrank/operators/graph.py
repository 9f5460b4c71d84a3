"""The directed weighted graph as two tables, and the measures that need no iteration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.functions.columns import billionths
from spreadrank.operators.skew import lookup
from spreadrank.params import DEFAULTS, SkewLimits
from spreadrank.storage import materialize, new_folder


@dataclass(frozen=True)
class Graph:
    """``edges(src, dst, weight)`` with one row per ordered pair, ``nodes(id)``, and their sizes.

    Both tables lie on shared storage, so the stages that read them do not recompute the log; the edges
    at ``edges_path``, for sessions other than the one they were made in.
    """

    edges: DataFrame
    nodes: DataFrame
    n_edges: int
    n_nodes: int
    edges_path: str

    def edges_in(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.edges.schema).parquet(self.edges_path)


def graph_edges(edge_table: DataFrame) -> DataFrame:
    """The edges by their ends; weights have nine decimals, in which all sums of them are exact."""
    return edge_table.select(
        F.col("src_user_id").cast("string").alias("src"),
        F.col("dst_user_id").cast("string").alias("dst"),
        billionths(F.col("edge_weight")).cast("double").alias("weight"),
    )


def node_set(edges: DataFrame) -> DataFrame:
    """All endpoints, once each."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def graph_from_edges(edges: DataFrame) -> Graph:
    """A graph from ``(src, dst, weight)`` rows that are already one per ordered pair."""
    path = new_folder(edges.sparkSession, "edges")
    edges = materialize(edges.select("src", "dst", "weight"), "edges", path)
    nodes = materialize(node_set(edges), "nodes")
    return Graph(edges, nodes, edges.count(), nodes.count(), path)


def build_graph(edge_table: DataFrame) -> Graph:
    return graph_from_edges(graph_edges(edge_table))


def out_totals(edges: DataFrame) -> DataFrame:
    """``(src, out_weight, out_degree)`` of the nodes that have out-edges."""
    total = F.sum(billionths(F.col("weight"))).cast("double")
    return edges.groupBy("src").agg(total.alias("out_weight"), F.count(F.lit(1)).alias("out_degree"))


def weighted_outdegree(graph: Graph) -> DataFrame:
    """Sum of out-edge weights of every node, 0 for a node without out-edges."""
    sums = out_totals(graph.edges).select(F.col("src").alias("id"), "out_weight")
    return graph.nodes.join(sums, "id", "left").select(
        "id", F.coalesce("out_weight", F.lit(0.0)).alias("weighted_outdegree")
    )


def outdegree(graph: Graph) -> DataFrame:
    counts = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("total"))
    return graph.nodes.join(counts, "id", "left").select(
        "id", F.coalesce("total", F.lit(0)).cast("bigint").alias("outdegree")
    )


def graph_stats(graph: Graph) -> DataFrame:
    """One row: number of nodes and edges, and that the graph is directed."""
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    return graph.edges.agg(F.count(F.lit(1)).alias("n_edges")).select(
        nodes.scalar().alias("n_nodes"), "n_edges", F.lit(True).alias("is_directed")
    )


def top_by_outdegree(graph: Graph, n: int = 5) -> DataFrame:
    """The ``n`` nodes with the greatest weighted out-degree; ties go by id."""
    return weighted_outdegree(graph).orderBy(F.desc("weighted_outdegree"), "id").limit(n)


def successors(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Out-edges of the given ``nodes(id)``."""
    return graph.edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(id)``."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(
        ids, edges["dst"] == ids["id"], "left_semi"
    )


def sample_graph(graph: Graph, n_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the subgraph on the ``n_nodes`` nodes with most out-edges.

    A chosen node stays even if none of its edges does.
    """
    nodes = outdegree(graph).orderBy(F.desc("outdegree"), "id").limit(n_nodes)
    return nodes, induced_edges(graph.edges, nodes)


def transition_probabilities(graph: Graph, limits: SkewLimits = DEFAULTS.skew) -> DataFrame:
    """First-step probability of every edge: its weight over the out-weight of its source."""
    totals = out_totals(graph.edges).select("src", "out_weight")
    joined = lookup(graph.edges, totals, ["src"], graph.n_edges, limits=limits)
    return joined.select(
        "src", "dst", "weight", (F.col("weight") / F.col("out_weight")).alias("prob")
    )
