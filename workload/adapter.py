"""Turns the driver's tables into an interaction log and stand-in embeddings.

An event is an interaction of its user with an account picked by a hash of the event id, with a
preference for low account numbers. A tenth more accounts than users exist, so some never act
and have no successors. The mapping is row by row. The log holds every kind of row that cleaning
has to deal with: repeated tweets, missing tweet ids, missing targets, self loops, unknown labels, and white space
around labels and ids, which makes them other labels and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Modulus and factors of the multiplicative hash of event ids.
MODULUS = 2147483647


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    accounts = events.agg(F.floor((F.max("user_id") + 1) * 11 / 10).alias("n")).scalar()
    mixed = F.col("event_id") % MODULUS * 48271 % MODULUS * 69621 % MODULUS
    target = F.floor(F.pow(mixed / F.lit(float(MODULUS)), F.lit(2.0)) * accounts)
    user = F.col("user_id").cast("string")
    return (
        events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .select(
            F.when(
                F.col("k") != 13,
                F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd"), user),
            ).alias("tweet_id"),
            F.concat(F.lit("u"), user).alias("src_user_id"),
            F.when(
                F.col("event_id") % 67 != 0,
                F.concat(
                    F.lit("u"), target.cast("string"), F.when(F.col("event_id") % 59 == 0, " ").otherwise("")
                ),
            ).alias("dst_user_id"),
            F.col("event_type").alias("interaction_type"),
            F.concat(
                F.when(F.col("event_id") % 53 == 0, " ").otherwise(""),
                F.when(F.col("k") < 50, "fake")
                .when(F.col("k") < 75, "unverified")
                .when(F.col("k") < 95, "real")
                .otherwise("satire"),
            ).alias("veracity"),
            F.col("event_id").alias("timestamp"),
        )
    )


def stand_in_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector)``: the stored vectors all have length 1, so they are stretched by id."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    factor = (F.lit(1) + F.col("vec_id") % 7).cast("double")
    return table.select(
        F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * factor).alias("vector"),
    )


def stand_in_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, x, y)``: the first two numbers of each vector as its place in the plane."""
    vectors = stand_in_vectors(spark, sf_dir)
    return vectors.select("id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


def stand_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(
        F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("id"),
        (F.col("label") % 3).alias("cluster"),
    )
