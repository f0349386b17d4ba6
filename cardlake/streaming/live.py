"""Streams of transactions: windows, repeats, enrichment, delayed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATE = "1 hour"


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def statistics(txn: DataFrame, length: str = "60 minutes", slide: str | None = None) -> DataFrame:
    """Counts, amounts and fraud rate by tumbling windows, or by sliding ones where slide is given."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    by = txn.withWatermark("ts", LATE).groupBy(w.alias("w"))
    return by.agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.avg("is_fraud").alias("rate")).select("w.start", "w.end", "n", "amount", "rate")


def sessions(txn: DataFrame, gap: str = "30 minutes") -> DataFrame:
    by = txn.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select("user_id", "w.start", "w.end", "n", "amount")


def once(txn: DataFrame, *key: str, within: str = LATE) -> DataFrame:
    """Rows whose key did not occur shortly before."""
    return txn.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(key))


def with_labels(scored: DataFrame, labels: DataFrame, hours: int = 72) -> DataFrame:
    """Scores with the labels (label_id, label, given) that come within hours of them."""
    a, b = scored.withWatermark("ts", LATE), labels.withWatermark("given", LATE)
    near = (F.col("transaction_id") == F.col("label_id")) & F.col("given").between(F.col("ts"), F.col("ts") + F.expr(f"interval {hours} hours"))
    return a.join(b, near)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what has come to a Parquet table; a run that is repeated after a failure writes nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
