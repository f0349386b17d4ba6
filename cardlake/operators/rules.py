"""Rule scores, bands and responses as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points(*rules: tuple[Column, float]) -> Column:
    """The sum of the points of rules that hold, in their order."""
    out = F.lit(0.0)
    for holds, p in rules:
        out = out + F.when(holds, F.lit(p)).otherwise(F.lit(0.0))
    return out


def steps(value: Column, *limits: tuple[float, float]) -> Column:
    """The points of the first limit that value exceeds."""
    out = F.lit(0.0)
    for limit, p in reversed(limits):
        out = F.when(value > limit, F.lit(p)).otherwise(out)
    return out


def base_score() -> Column:
    s = steps(F.col("amount_vs_avg"), (5, 0.3), (3, 0.2), (2, 0.1))
    s = s + points((F.col("is_high_amount"), 0.2)) + points((F.col("is_unusual_hour"), 0.15)) + points((F.col("is_rapid"), 0.25))
    s = s + steps(F.col("velocity"), (10, 0.2), (5, 0.1)) + steps(F.col("daily_count"), (50, 0.15), (25, 0.1))
    return F.least(s, F.lit(1.0))


def enhanced_score() -> Column:
    s = points((F.col("is_high_amount"), 0.3), (F.col("is_unusual_hour"), 0.2), (F.col("is_rapid"), 0.25), (F.col("velocity") > 10, 0.15), (F.col("amount_vs_avg") > 5, 0.2))
    return F.least(s, F.lit(1.0))


def band(score: Column, *limits: tuple[float, str], low: str) -> Column:
    out = F.lit(low)
    for limit, name in reversed(limits):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def severity(score: Column) -> Column:
    return band(score, (0.9, "CRITICAL"), (0.8, "HIGH"), (0.6, "MEDIUM"), (0.4, "LOW"), low="MINIMAL")


def risk_level(score: Column) -> Column:
    return band(score, (0.9, "CRITICAL"), (0.7, "HIGH"), (0.5, "MEDIUM"), low="LOW")


def confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.abs(score - 0.5))


def scored(features: DataFrame) -> DataFrame:
    return features.withColumns({"fraud_score": base_score(), "ml_prediction": enhanced_score()})


class Adjustment(NamedTuple):
    """A rule that changes a score where it holds; null counts as not holding."""

    name: str
    holds: Column
    change: Callable[[Column], Column]


def adjusted(df: DataFrame, score: str, rules: Iterable[Adjustment]) -> DataFrame:
    """df with adjusted, the score after all rules in their order, and applied, the name and delta of each rule that held."""
    out = df.withColumns({"adjusted": F.col(score), "applied": F.array().cast("array<struct<name:string,delta:double>>")})
    for r in rules:
        holds = F.coalesce(r.holds, F.lit(False))
        step = out.withColumn("_next", F.when(holds, r.change(F.col("adjusted"))).otherwise(F.col("adjusted")))
        note = F.struct(F.lit(r.name).alias("name"), (F.col("_next") - F.col("adjusted")).alias("delta"))
        out = step.withColumns({"applied": F.when(holds, F.array_append("applied", note)).otherwise(F.col("applied")), "adjusted": F.col("_next")}).drop("_next")
    return out


def fallback_score() -> Column:
    """The score of a transaction that no model scored."""
    s = points((F.col("is_high_amount"), 0.3), (F.col("is_rapid"), 0.2), (F.col("is_unusual_hour"), 0.1), (F.col("amount_vs_avg") > 5, 0.4))
    return F.least(s, F.lit(1.0))


def recommended_actions(score: Column) -> Column:
    """The sorted, distinct actions of a score's band and of the flags is_high_amount and is_unusual_hour."""
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    by_band = (
        F.when(score >= 0.9, names("block_transaction", "freeze_account", "immediate_investigation"))
        .when(score >= 0.7, names("require_additional_authentication", "flag_for_review"))
        .when(score >= 0.5, names("enhanced_monitoring", "risk_assessment"))
        .otherwise(F.array().cast("array<string>"))
    )
    checks = F.array_compact(F.array(F.when(F.col("is_high_amount"), "amount_verification"), F.when(F.col("is_unusual_hour"), "time_verification")))
    return F.array_sort(F.array_distinct(F.concat(by_band, checks)))
