"""Weighted interactions to one edge per ordered pair of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.columns import edge_weight, exact_sum
from spreadrank.params import DEFAULTS


def edge_totals(df: DataFrame) -> DataFrame:
    """Group by source and target. A reader of the weight alone does not pay for the type."""
    first = F.struct("timestamp", "tweet_id", "interaction_type")
    totals = df.groupBy("src_user_id", "dst_user_id").agg(
        exact_sum(F.col("veracity_weight")).alias("veracity_score"),
        F.count(F.lit(1)).alias("interaction_count"),
        F.min_by("interaction_type", first).alias("interaction_type"),
    )
    return totals.withColumn(
        "edge_weight", edge_weight(F.col("veracity_score"), F.col("interaction_count"))
    )


def aggregate_edges(df: DataFrame, min_edge_weight: float = DEFAULTS.min_edge_weight) -> DataFrame:
    return edge_totals(df).filter(F.col("edge_weight") >= min_edge_weight)
