"""Investigators' feedback on alerts: which of it counts, and what it agrees on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_alerts(alerts: DataFrame) -> DataFrame:
    """One to three feedback rows an alert, a fixed function of it."""
    i = F.col("i")
    one = alerts.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))))
    investigator = (F.col("transaction_id") * 7 + i) % 11
    return one.select(
        "transaction_id",
        "user_id",
        i,
        investigator.alias("investigator"),
        F.when((F.col("k") + i) % 4 < 2, "fraud").otherwise("legitimate").alias("label"),
        (0.6 + 0.04 * ((F.col("transaction_id") + i) % 10)).alias("confidence"),
        (1 + (F.col("transaction_id") + 3 * i) % 8).alias("minutes"),
        F.col("fraud_score").alias("prediction"),
        (0.4 + 0.06 * investigator).alias("accuracy"),
        F.timestamp_micros(F.unix_micros("ts") + (1 + i) * 3_600_000_000).alias("given"),
    )


def usable(feedback: DataFrame) -> DataFrame:
    """Confident, considered feedback of able investigators that does not contradict a clear prediction."""
    sure, p = F.round("confidence", 6), F.col("prediction")
    against = (sure > 0.9) & (((F.col("label") == "fraud") & (p < 0.1)) | ((F.col("label") == "legitimate") & (p > 0.9)))
    return feedback.filter((sure >= 0.7) & (F.round("accuracy", 6) >= 0.6) & (F.col("minutes") >= 2) & ~against)


def eligible(feedback: DataFrame, as_of: DataFrame) -> DataFrame:
    """Transactions with two confirmations or a newest one at least an hour old, and none older than 72 hours. as_of: one row, column as_of."""
    age = (F.unix_micros("as_of") - F.unix_micros("given")) / 3.6e9
    by = feedback.crossJoin(F.broadcast(as_of)).groupBy("transaction_id").agg(F.count("*").alias("n"), F.min(age).alias("newest"), F.max(age).alias("oldest"))  # one row
    return by.filter(((F.col("n") >= 2) | (F.col("newest") >= 1)) & (F.col("oldest") <= 72))


def consensus(feedback: DataFrame, least: float = 0.8, consistency: float = 0.9) -> DataFrame:
    """The label of most weight and its share of all weight, where that is least or more; equal weights go to fraud."""
    weight = F.col("confidence") * F.col("accuracy") * consistency
    by_label = feedback.groupBy("transaction_id", "label").agg(F.sum(weight).alias("w"))
    best = F.max(F.struct(F.round("w", 6).alias("w"), (F.col("label") == "fraud").alias("is_fraud"))).alias("best")
    out = by_label.groupBy("transaction_id").agg(F.sum("w").alias("total"), best)
    return out.select(
        "transaction_id",
        F.when(F.col("best.is_fraud"), "fraud").otherwise("legitimate").alias("label"),
        F.round(F.col("best.w") / F.col("total"), 5).alias("consensus"),
    ).filter(F.col("consensus") >= least)


def weights(feedback: DataFrame, as_of: DataFrame, decay_hours: float = 24.0) -> DataFrame:
    """How much each agreed transaction counts in training. as_of: one row, column as_of."""
    age = (F.unix_micros("as_of") - F.unix_micros("given")) / 3.6e9
    by = feedback.crossJoin(F.broadcast(as_of)).groupBy("transaction_id").agg(  # one row
        (F.sum(F.col("confidence") * F.col("accuracy")) / F.sum("accuracy")).alias("weighted_confidence"),
        F.avg(F.exp(-age / decay_hours)).alias("temporal_weight"),
        F.least(F.lit(0.2), F.count("*") * 0.1).alias("bonus"),
        (F.avg("accuracy") * F.avg("confidence")).alias("trust"),
    )
    out = by.join(consensus(feedback).select("transaction_id", "consensus"), "transaction_id")
    out = out.withColumn("quality", F.least(F.lit(1.0), (F.col("consensus") + F.col("bonus")) * F.col("trust")))
    include = (F.round("quality", 6) > 0.7) & (F.col("consensus") > 0.8)
    return out.withColumns({"training_weight": F.least(F.lit(1.0), F.col("quality") * F.col("temporal_weight")), "include": include}).drop("bonus", "trust")
