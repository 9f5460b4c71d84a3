"""The influence score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.columns import composite_score, l2_norm
from spreadrank.params import DEFAULTS

# Column to be scaled and the name of its scaled form.
SCALED = {
    "emb_norm": "emb_norm_n",
    "pagerank": "pagerank_n",
    "weighted_outdegree": "outdegree_n",
}


def embedding_norms(vectors: DataFrame) -> DataFrame:
    """``(id, emb_norm)`` from ``(id, vector)`` with an array of numbers."""
    return vectors.select("id", l2_norm(F.col("vector")).alias("emb_norm"))


def build_scores(norms: DataFrame, pagerank: DataFrame, outdegree: DataFrame) -> DataFrame:
    """One row per embedded node; a node without PageRank or out-degree has 0 there."""
    return (
        norms.join(pagerank, "id", "left")
        .join(outdegree, "id", "left")
        .select(
            F.col("id").alias("node_id"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SCALED],
        )
    )


def scale_columns(df: DataFrame) -> DataFrame:
    """Bring the three measures to [0, 1]; a column with a single value becomes 0."""
    ranges = df.agg(
        F.struct(
            *[F.min(c).alias(f"{c}_min") for c in SCALED],
            *[F.max(c).alias(f"{c}_max") for c in SCALED],
        ).alias("r")
    )
    wide = df.withColumn("_r", ranges.scalar())

    def scaled(name: str):
        low, high = F.col(f"_r.{name}_min"), F.col(f"_r.{name}_max")
        return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(F.lit(0.0))

    return wide.select(*df.columns, *[scaled(c).alias(n) for c, n in SCALED.items()])


def score(df: DataFrame, alpha=DEFAULTS.alpha, beta=DEFAULTS.beta, gamma=DEFAULTS.gamma) -> DataFrame:
    """Scaled measures and their weighted sum, not yet ranked."""
    return scale_columns(df).withColumn(
        "influence_score",
        composite_score(
            F.col("emb_norm_n"), F.col("pagerank_n"), F.col("outdegree_n"), alpha, beta, gamma
        ),
    )
