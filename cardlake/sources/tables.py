"""Logical tables of payment analytics, derived from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("gmail", "yahoo", "hotmail", "outlook", "aol", "icloud")
EPOCH = "2024-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as card transactions, a row each."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    email = F.lit(None).cast("string")
    for i, d in enumerate(DOMAINS):
        email = F.when(F.col("event_id") % 7 == i, d).otherwise(email)
    return e.select(
        F.col("event_id").alias("transaction_id"),
        "user_id",
        "ts",
        F.col("value").alias("amount"),
        F.col("event_type").alias("product"),
        k.alias("k"),
        (k < 3).cast("int").alias("is_fraud"),
        (F.col("user_id") * 10 + k % 3).alias("card1"),
        F.expr("cast(get_json_object(props, '$.k') as int) div 5").alias("addr1"),
        F.concat(F.col("user_id").cast("string"), F.lit("_"), (k % 3).cast("string")).alias("device"),
        email.alias("p_email"),
        (F.unix_seconds("ts") - F.unix_seconds(F.lit(EPOCH).cast("timestamp"))).alias("dt"),
    )
