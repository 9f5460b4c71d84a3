"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spreadrank.params import VERACITY_WEIGHTS


def veracity_weight(veracity: Column, weights: tuple = VERACITY_WEIGHTS) -> Column:
    """Weight of a label; every label without one of its own weighs as much as the last one listed."""
    *first, (_, rest) = weights
    weight = F.lit(float(rest))
    for label, value in reversed(first):
        weight = F.when(veracity == label, F.lit(float(value))).otherwise(weight)
    return weight


def exact_sum(weight: Column) -> Column:
    """Sum of weights that does not depend on row order: added up in whole millionths."""
    return F.sum(F.round(weight * 1e6).cast("bigint")) / F.lit(1e6)


def billionths(weight: Column) -> Column:
    """An edge weight as a decimal. Sums of decimals are exact, so they do not depend on row order."""
    return weight.cast("decimal(28,9)")


def share_sum(share: Column) -> Column:
    """Sum of shares of a whole that does not depend on row order: added up in units of 2^-60."""
    return F.sum((share * F.lit(2.0**60)).cast("bigint")) / F.lit(2.0**60)


def edge_weight(score: Column, count: Column) -> Column:
    return score + F.log1p(count)


def hex_uniform(digest: Column, start: int = 1) -> Column:
    """Uniform number strictly between 0 and 1 from 13 hex digits of a digest."""
    return (F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(
        float(2**52)
    )


def uniform_sql(digest: str, start: int = 1) -> str:
    """``hex_uniform`` as SQL text."""
    return f"(cast(conv(substr({digest}, {start}, 13), 16, 10) as bigint) + 0.5D) / {float(2**52)!r}D"


def digest(*parts) -> Column:
    """md5 of the parts joined by ``|``: the same draw whatever the partitioning."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when a vector is missing or has no length."""
    lengths = l2_norm(a) * l2_norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def composite_score(norm: Column, rank: Column, degree: Column, alpha, beta, gamma) -> Column:
    return alpha * norm + beta * rank + gamma * degree


# Marker sizes of the charts.


def node_size(score: Column) -> Column:
    """Marker size on the network map."""
    return score * 3000 + 100


def point_size(score: Column) -> Column:
    """Marker size on the cluster scatter."""
    return score * 500 + 30
