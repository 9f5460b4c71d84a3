"""From the raw log to weighted interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.functions.columns import veracity_weight
from spreadrank.params import VERACITY_WEIGHTS

# The row that stays of a set of duplicates is the least one by these columns, NULLs first.
KEEP_ORDER = ["timestamp", "src_user_id", "dst_user_id", "interaction_type", "veracity", "tweet_id"]


def clean_interactions(
    df: DataFrame, key: tuple[str, ...] = ("tweet_id",), weights: tuple = VERACITY_WEIGHTS
) -> DataFrame:
    """Drop incomplete rows, self loops, repeats of ``key`` and labels without a weight, in this order.

    Rows without a key count as repeats of each other. The label is looked at after the repeats
    are gone, so a tweet whose first row has an unknown label is lost altogether. The least row per
    key is found by an aggregate and not by a window: each task sends on one row per key, so a key
    with a large share of the log, such as NULL, does not end up in one task.
    """
    kept = df.filter(
        F.col("src_user_id").isNotNull()
        & F.col("dst_user_id").isNotNull()
        & F.col("veracity").isNotNull()
        & (F.col("src_user_id") != F.col("dst_user_id"))
    )
    rest = [c for c in KEEP_ORDER if c not in key]
    least = kept.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row"))
    return (
        least.select(*key, "row.*")
        .filter(F.col("veracity").isin([label for label, _ in weights]))
        .select(*[c for c in df.columns])
    )


def assign_veracity_weights(df: DataFrame, weights: tuple = VERACITY_WEIGHTS) -> DataFrame:
    return df.withColumn("veracity_weight", veracity_weight(F.col("veracity"), weights))
