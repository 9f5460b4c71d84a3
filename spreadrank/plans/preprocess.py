"""Log to edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spreadrank.operators.cleaning import assign_veracity_weights, clean_interactions
from spreadrank.operators.edges import aggregate_edges, edge_totals
from spreadrank.params import DEFAULTS, Params
from spreadrank.sources.interactions import load_interactions
from spreadrank.storage import materialize


def weighted_interactions(interactions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    weights = params.veracity_weights
    return assign_veracity_weights(clean_interactions(interactions, weights=weights), weights)


def edge_table(interactions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The whole of preprocessing as one lazy plan with two shuffles."""
    return aggregate_edges(weighted_interactions(interactions, params), params.min_edge_weight)


def run_preprocessing(spark: SparkSession, path: str, fmt: str = "csv", params: Params = DEFAULTS) -> DataFrame:
    return edge_table(load_interactions(spark, path, fmt), params)


def observed_edges(interactions: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The edge table, written, and ``(stage, rows)`` counted while it was: the log is read and cleaned once.

    A stage that Spark has to run again after losing an executor may be counted twice; ``stage_counts`` counts the rows themselves.
    """
    spark = interactions.sparkSession
    seen = {name: Observation() for name in ("loaded", "cleaned", "edges")}

    def watched(df: DataFrame, name: str) -> DataFrame:
        return df.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    cleaned = watched(weighted_interactions(watched(interactions, "loaded"), params), "cleaned")
    edges = materialize(watched(aggregate_edges(cleaned, params.min_edge_weight), "edges"), "edges")
    rows = [(name, seen[name].get["rows"]) for name in seen]
    return edges, spark.createDataFrame(rows, "stage string, rows long")


def stage_counts(interactions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(stage, rows)`` for loaded, cleaned and edges.

    The edge totals know how many clean rows they come from, so cleaning runs once for
    both of the later counts.
    """
    counts = edge_totals(weighted_interactions(interactions, params)).agg(
        F.coalesce(F.sum("interaction_count"), F.lit(0)).alias("cleaned"),
        F.count(F.when(F.col("edge_weight") >= params.min_edge_weight, 1)).alias("edges"),
    )
    loaded = interactions.agg(F.count(F.lit(1)).alias("rows"))
    later = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("cleaned").alias("stage"), F.col("cleaned").alias("rows")),
                F.struct(F.lit("edges").alias("stage"), F.col("edges").alias("rows")),
            )
        ).alias("s")
    ).select("s.*")
    return loaded.select(F.lit("loaded").alias("stage"), "rows").unionByName(later)
