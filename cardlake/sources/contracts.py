"""Contracts of the records on the wire: fields, and the values that enumerated ones may have. A row that breaks its contract is kept apart, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", _L, False), T.StructField("user_id", _L, False), T.StructField("ts", _TS, False), T.StructField("amount", _D, False), T.StructField("product", _S),
        T.StructField("location", T.StructType([T.StructField("addr1", _L)])), T.StructField("metadata", T.MapType(_S, _S)),
    ]
)
SCORE = T.StructType([T.StructField("transaction_id", _L, False), T.StructField("fraud_score", _D, False), T.StructField("risk_level", _S), T.StructField("rules", T.ArrayType(_S))])
ALERT = T.StructType(
    [
        T.StructField("alert_id", _S, False), T.StructField("user_id", _L, False), T.StructField("severity", _S), T.StructField("fraud_score", _D),
        T.StructField("transaction_details", T.StructType([T.StructField("amount", _D), T.StructField("product", _S)])),
        T.StructField("risk_factors", T.StructType([T.StructField("is_high_amount", T.BooleanType()), T.StructField("is_unusual_hour", T.BooleanType()), T.StructField("is_rapid", T.BooleanType()), T.StructField("velocity", _D)])),
    ]
)
DOMAINS: dict[str, tuple[str, ...]] = {"severity": ("LOW", "MEDIUM", "HIGH", "CRITICAL"), "risk_level": ("LOW", "MEDIUM", "HIGH", "CRITICAL"), "product": ("click", "error", "purchase", "signup", "view")}


def broken(contract: T.StructType, value: str, domains: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Why a parsed value (a struct column) breaks its contract: fields that are missing or outside their domain; an empty array where it doesn't."""
    domains = DOMAINS if domains is None else domains
    missing = [F.when(F.col(f"{value}.{f.name}").isNull(), f"missing_{f.name}") for f in contract if not f.nullable]
    outside = [F.when(~F.col(f"{value}.{f.name}").isin(*domains[f.name]), f"unknown_{f.name}") for f in contract if f.name in domains]
    return F.array_compact(F.array(*missing, *outside))


def decoded(messages: DataFrame, contract: T.StructType, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """messages with v, their JSON value by the contract, and errors. Text that is no JSON breaks every contract with a required field."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in contract])
    return messages.withColumn("v", F.from_json(F.col("value").cast("string"), nullable)).withColumn("errors", broken(contract, "v", domains))
