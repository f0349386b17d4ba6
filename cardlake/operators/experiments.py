"""Deterministic assignment of users to variants of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.operators.evaluation import cells, rates


def bucket(user_id: Column, experiment: str, buckets: int = 10_000) -> Column:
    """The MD5 of "user:experiment" as a number, modulo buckets, folded over eight groups of four hex digits."""
    digest = F.md5(F.concat(user_id.cast("string"), F.lit(f":{experiment}")).cast("binary"))
    out = F.lit(0).cast("long")
    for i in range(8):
        part = F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")
        out = F.pmod(out * 65536 + part, F.lit(buckets))
    return out


def precision_test(scorecard: DataFrame) -> DataFrame:
    """The difference of two variants' precision and its pooled z, in one row. scorecard: a row a variant with predictions, tp and fp."""
    of = lambda v, c: F.coalesce(F.sum(F.when(F.col("variant") == v, c)), F.lit(0))
    said = F.col("tp") + F.col("fp")
    one = scorecard.agg(
        F.sum("predictions").alias("predictions"), of("control", said).alias("nc"), of("treatment", said).alias("nt"), of("control", F.col("tp")).alias("tc"), of("treatment", F.col("tp")).alias("tt")
    )
    pc, pt = F.try_divide("tc", "nc"), F.try_divide("tt", "nt")
    p = F.try_divide(F.col("tc") + F.col("tt"), F.col("nc") + F.col("nt"))
    spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("nc")) + F.try_divide(F.lit(1), F.col("nt"))))
    return one.withColumns({"effect": pt - pc, "z": F.try_divide(pt - pc, spread)})


def report(scorecard: DataFrame, target: int, least: int = 50, z_limit: float = 1.959964) -> DataFrame:
    """Which variant is better, and whether to stop: a clear difference, or hardly any after half the target. z_limit is the two-sided 5 % bound."""
    t = precision_test(scorecard)
    enough, clear = F.least("nc", "nt") >= least, F.abs("z") > z_limit
    decision = F.when(~enough, "insufficient").when(clear, F.when(F.col("z") > 0, "treatment").otherwise("control")).otherwise("no difference")
    return t.withColumns({"decision": decision, "stop": (enough & clear) | ((F.abs("effect") < 0.1) & (F.col("predictions") > target / 2))})


def scorecard(df: DataFrame, experiment: str, said: Column, true: Column, value: Column, control: int = 5000) -> DataFrame:
    """By variant: predictions (n), tp, tn, fp, fn, and the value of fraud detected and missed."""
    variant = F.when(bucket(F.col("user_id"), experiment) <= control, "control").otherwise("treatment")
    worth = lambda holds: F.sum(F.when(holds, value).otherwise(0.0))
    return df.groupBy(variant.alias("variant")).agg(F.count("*").alias("n"), *cells(said, true), worth(said & true).alias("detected"), worth(~said & true).alias("missed"))


def metric_value(metric: Column) -> Column:
    """The value of the named metric for a row of a scorecard; null for an unknown name."""
    known = rates() | {"business_value": F.col("detected") - F.col("missed") - 10 * F.col("fp")}
    out = F.lit(None).cast("double")
    for name, value in known.items():
        out = F.when(metric == name, value).otherwise(out)
    return out


def proportion_tests(card: DataFrame, tested: dict[str, tuple[str, str]]) -> DataFrame:
    """metric, effect and pooled z of treatment against control, for metrics given as hits and trials of a scorecard (SQL expressions)."""
    of = lambda v, e: F.sum(F.when(F.col("variant") == v, F.expr(e))).cast("double")
    made = [F.struct(F.lit(m).alias("metric"), of("control", a).alias("sc"), of("treatment", a).alias("st"), of("control", b).alias("nc"), of("treatment", b).alias("nt")) for m, (a, b) in tested.items()]
    one = card.agg(F.array(*made).alias("m")).select(F.inline("m"))
    pc, pt = F.try_divide("sc", "nc"), F.try_divide("st", "nt")
    q = F.try_divide(F.col("sc") + F.col("st"), F.col("nc") + F.col("nt"))
    return one.select("metric", (pt - pc).alias("effect"), F.try_divide(pt - pc, F.sqrt(q * (1 - q) * (F.try_divide(F.lit(1), F.col("nc")) + F.try_divide(F.lit(1), F.col("nt"))))).alias("z"))
