"""Reading and writing of records: CSV, JSON with bad rows kept apart, tables by month, and nested messages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again, so that work which passes over it often does not compute it each time."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """df, written once in buckets of key (by default as many as a shuffle has partitions), sorted within them: joins and groups by key need no exchange on this side. The table's name is its own."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


def csv(spark: SparkSession, path: str, schema: StructType, first: int | None = None) -> DataFrame:
    """A CSV table with a header and typed columns, whole or its first rows; what can't be read as its type is null."""
    rows = spark.read.csv(path, schema=schema, header=True)
    return rows if first is None else rows.limit(first)


def parsed(df: DataFrame, text: str, schema: str) -> DataFrame:
    """df with parsed, the JSON in text, and is_bad where a text is no such JSON. A null text is not bad."""
    made = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("parsed", made).withColumn("is_bad", F.coalesce(F.col("parsed._bad").isNotNull(), F.lit(False)))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the dead letters of parsed rows."""
    return df.filter(~F.col("is_bad")), df.filter("is_bad")


def append_by_month(df: DataFrame, path: str) -> None:
    """Appends to a table in folders by month, sorted by user and time within its files. A month is dealt over many tasks by user."""
    by_month = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    by_month.repartition("month", "user_id").sortWithinPartitions("month", "user_id", "ts").write.partitionBy("month").mode("append").parquet(path)


def message(key: str, *body: Column) -> list[Column]:
    """key and value of a message whose value is JSON."""
    return [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*body)).alias("value")]


def alert_message(alerts: DataFrame) -> DataFrame:
    factors = F.struct("is_high_amount", "is_unusual_hour", "is_rapid", "velocity").alias("risk_factors")
    details = F.struct("amount", "product").alias("transaction_details")
    alert_id = F.concat(F.lit("alert_"), F.col("transaction_id").cast("string")).alias("alert_id")
    return alerts.select(*message("user_id", alert_id, F.col("user_id"), F.col("severity"), F.round("fraud_score", 6).alias("fraud_score"), details, factors))


def detection_result(scored: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """A nested row a transaction: scores, the rules that hold as an array and the features as a map."""
    flags = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("is_high_amount", "is_unusual_hour", "is_rapid")]))
    values = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(c).cast("double") for c in features]))
    return scored.select("transaction_id", "user_id", "ts", F.struct("fraud_score", "ml_prediction").alias("scores"), flags.alias("explanation"), values.alias("features"))
