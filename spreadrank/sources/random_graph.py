"""Random directed graphs for timing runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadrank.functions.columns import digest, hex_uniform
from spreadrank.params import DEFAULTS

# The weight of a fake and of a real edge.
FAKE_WEIGHT, REAL_WEIGHT = 1.0, 0.2


def draws_per_source(n_nodes: int, edge_prob: float) -> int:
    """Gaps to draw at once: six standard deviations more than a source is expected to need."""
    expected = n_nodes * edge_prob
    return min(n_nodes, math.ceil(expected + 6 * math.sqrt(expected) + 10))


def random_graph(
    spark: SparkSession,
    n_nodes: int,
    edge_prob: float = DEFAULTS.edge_prob,
    fake_ratio: float = DEFAULTS.fake_ratio,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """``(src, dst, weight)``: each ordered pair of different nodes with probability ``edge_prob``.

    The targets of a source are found by jumping over the absent ones: gaps between
    successes of independent trials are geometric. So the work follows the edges and not the
    pairs. A source whose first draws do not reach the last node goes on with as many as there could
    be; that branch is nearly always empty.
    """
    first = draws_per_source(n_nodes, edge_prob)
    sources = spark.range(n_nodes).select(F.col("id").alias("src"))

    def jumps(starts: DataFrame, low: int, high: int) -> DataFrame:
        along = Window.partitionBy("src").orderBy("i")
        u = hex_uniform(digest(seed, F.col("src"), F.col("i")))
        if edge_prob >= 1.0:
            gap = F.lit(1)
        else:
            gap = F.least(F.floor(F.log(u) / F.lit(math.log(1.0 - edge_prob))), F.lit(n_nodes)) + 1
        return (
            starts.withColumn("i", F.explode(F.sequence(F.lit(low), F.lit(high))))
            .withColumn("gap", gap)
            .withColumn("dst", F.col("start") + F.sum("gap").over(along))
            .select("src", "dst")
        )

    begun = jumps(sources.withColumn("start", F.lit(-1).cast("bigint")), 1, first)
    reached = begun
    if first < n_nodes:
        short = (
            begun.groupBy("src").agg(F.max("dst").alias("start")).filter(F.col("start") < n_nodes - 1)
        )
        reached = begun.unionByName(jumps(short, first + 1, n_nodes))
    fake = hex_uniform(digest(seed, F.col("src"), F.lit("to"), F.col("dst"))) < fake_ratio
    return reached.filter((F.col("dst") < n_nodes) & (F.col("src") != F.col("dst"))).select(
        "src", "dst", F.when(fake, FAKE_WEIGHT).otherwise(REAL_WEIGHT).alias("weight")
    )
