"""Joins that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadrank.params import DEFAULTS, SkewLimits
from spreadrank.storage import materialize


def hot_keys(df: DataFrame, on: list[str], rows: int, limits: SkewLimits = DEFAULTS.skew) -> DataFrame:
    """Keys with more rows than the threshold, and their row count ``n``; the ``limits.max_hot`` most frequent
    ones if the table has more rows than ``rows`` says.

    The counts are combined before the shuffle. The bound on the number of keys is what makes the result safe
    to broadcast. A key that is left out is joined like any other, so it costs time and no rows.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limits.threshold(rows))
    return counts.orderBy(F.desc("n"), *on).limit(limits.max_hot)


def found_hot(df: DataFrame, on: list[str], rows: int, limits: SkewLimits = DEFAULTS.skew) -> DataFrame | None:
    """``hot_keys``, written out, or nothing where no key is hot, which spares the join its second branch.

    Of a key of several columns the first is counted alone, since a hot key has a hot first column: it has few
    values, so little is shuffled. The whole key is counted for the rows with a hot one only.
    """
    hot = materialize(hot_keys(df, on[:1], rows, limits), "hot")
    if len(on) > 1 and not hot.isEmpty():
        df = df.join(F.broadcast(hot.select(on[0])), on[0], "left_semi")
        hot = materialize(hot_keys(df, on, rows, limits), "hot")
    return None if hot.isEmpty() else hot


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: DataFrame,
    hot_on: list[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join where the rows of hot keys never meet in one shuffle partition.

    Rows whose key is in ``hot`` are joined map-side with the few right rows of those keys, the
    others by an ordinary join. ``right`` must have a bounded number of rows per hot key. ``how`` is
    inner or left.
    """
    marked = left.join(F.broadcast(hot.select(*hot_on, F.lit(True).alias("_hot"))), hot_on, "left")
    few = right.join(F.broadcast(hot.select(*hot_on)), hot_on, "left_semi")
    usual = marked.filter(F.col("_hot").isNull()).drop("_hot").join(right, on, how)
    heavy = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(few), on, how)
    return usual.unionByName(heavy)


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    rows: int,
    how: str = "inner",
    limits: SkewLimits = DEFAULTS.skew,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` (``rows`` rows) with ``right``, which has one row per key.

    Up to ``limits.min_rows`` rows no key can be hot and a plain join does. Keys are counted in ``counted``, a table with
    the keys of ``left`` that costs less to read, or in ``left`` itself.
    """
    hot = found_hot(left if counted is None else counted, on, rows, limits) if rows > limits.min_rows else None
    if hot is None:
        return left.join(right, on, how)
    return split_join(left, right, on, hot, on, how)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    rows: int,
    limits: SkewLimits = DEFAULTS.skew,
) -> DataFrame:
    """Inner join for a ``right`` side with many rows per key.

    The left rows of a hot key are dealt out over ``n / threshold`` slices by a hash of
    ``spread_by``; its right rows are repeated once per slice. Each repeat serves more than
    ``threshold`` / 2 left rows, so the copies stay a small part of the join's own output.
    """
    if rows <= limits.min_rows:
        return left.join(right, on)
    size = limits.threshold(rows)
    hot = found_hot(left, on, rows, limits)
    if hot is None:
        return left.join(right, on)
    slices = F.broadcast(hot.select(*on, F.ceil(F.col("n") / size).cast("int").alias("_slices")))
    left_cut = left.join(slices, on, "left").withColumn(
        "_slice", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_slices")).cast("int"), F.lit(0))
    )
    right_cut = right.join(slices, on, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    )
    return left_cut.drop("_slices").join(right_cut.drop("_slices"), [*on, "_slice"]).drop("_slice")
