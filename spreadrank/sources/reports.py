"""Writing the ranked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spreadrank.sources.interactions import CSV
from spreadrank.storage import publish


def save_report(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a table below ``path``, replacing what is there once it is whole, and return the path.

    Values keep their white space. The rank is the first column of a ranked table, and each file is in
    its order; ``rank_rows`` has dealt the ranks out in ranges, so nothing is shuffled for it.
    """
    if "rank" in df.columns:
        df = df.select("rank", *[c for c in df.columns if c != "rank"]).sortWithinPartitions("rank")
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}; use 'csv' or 'parquet'")
    publish(df.sparkSession, path, lambda to: df.write.options(**CSV).csv(to) if fmt == "csv" else df.write.parquet(to))
    return path
