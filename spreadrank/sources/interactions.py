"""Reading and staging the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spreadrank.storage import publish

# The columns of the log.
SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.StringType()),
        T.StructField("src_user_id", T.StringType()),
        T.StructField("dst_user_id", T.StringType()),
        T.StructField("interaction_type", T.StringType()),
        T.StructField("veracity", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)


# Text goes in and out as it is: white space is kept, and a quote in a quoted field is doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def load_interactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read the log from any Hadoop URI with the fixed schema; nothing is inferred or counted.

    CSV files have a header row. Columns go by position, an empty field or an unparseable number is
    NULL, and white space is kept. Parquet columns go by name.
    """
    return _read(spark, path, fmt, SCHEMA)


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(**CSV).csv(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {fmt!r}; use 'csv' or 'parquet'")


def input_uri(host: str | None, folder: str, local_path: str, name: str = "interactions.csv") -> str:
    """The staged copy when a file system host is named, else the local path."""
    if not host:
        return local_path
    return f"{host.rstrip('/')}/{folder.strip('/')}/{name}"


def stage_interactions(
    spark: SparkSession, source: str, target: str, fmt: str = "csv"
) -> DataFrame:
    """Replace ``target`` with a copy of ``source`` and return the copy; a failed write raises and leaves the old one.

    CSV fields are copied as text, so a value that does not fit its column, such as an unparseable
    timestamp, is in the copy as well.
    """
    if fmt == "csv":
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMA])
        copy = _read(spark, source, fmt, text)
        publish(spark, target, lambda to: copy.write.options(**CSV).csv(to))
    else:
        copy = _read(spark, source, fmt, SCHEMA)
        publish(spark, target, lambda to: copy.write.parquet(to))
    return load_interactions(spark, target, fmt)
