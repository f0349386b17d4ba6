"""Histories of metrics, comparisons of two runs, and the kinds of a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def head_tail(history: DataFrame, order: str, value: str, share: float = 0.2, least: int = 10) -> DataFrame:
    """Means and variances of the first and the last share of a history of one row a period; no row if it has fewer than least."""
    every = Window.partitionBy(F.lit(0))
    m = F.greatest(F.lit(2), F.floor(share * F.count("*").over(every)))
    ranked = history.withColumns({"m": m, "_a": F.row_number().over(every.orderBy(order)), "_z": F.row_number().over(every.orderBy(F.desc(order)))})
    head, tail = F.when(F.col("_a") <= F.col("m"), F.col(value)), F.when(F.col("_z") <= F.col("m"), F.col(value))
    out = ranked.agg(
        F.avg(head).alias("head"), F.avg(tail).alias("tail"), F.var_samp(head).alias("head_var"), F.var_samp(tail).alias("tail_var"), F.max("m").alias("m"), F.count("*").alias("n")
    )
    return out.filter(F.col("n") >= least)


def runs(df: DataFrame, key: str, latency: str, error: str) -> DataFrame:
    """The current rows against the reference rows (boolean is_reference) by key; regressed if slower by a tenth, fewer by a tenth or a hundredth more errors."""
    side = lambda c, ref: F.when(F.col("is_reference") if ref else ~F.col("is_reference"), F.col(c))
    by = df.groupBy(key).agg(*[f(side(c, ref)).alias(f"{n}{int(ref)}") for ref in (True, False) for n, f, c in (("l", F.avg, latency), ("n", F.count, key), ("e", F.avg, error))])
    worse = (F.col("l0") > 1.1 * F.col("l1")) | (F.col("n0") < 0.9 * F.col("n1")) | (F.col("e0") > F.col("e1") + 0.01)
    return by.select(
        key,
        F.try_divide("l1", "l0").alias("latency_factor"),
        F.try_divide("n0", "n1").alias("throughput_factor"),
        (F.col("e0") - F.col("e1")).alias("error_change"),
        worse.alias("regressed"),
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """name and kind of each column; strings that are all T or F are boolean. The strings are read once."""
    known = ((T.FractionalType, "float"), (T.IntegralType, "integer"), (T.BooleanType, "boolean"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "time"))
    kinds = {f.name: next((k for t, k in known if isinstance(f.dataType, t)), None if isinstance(f.dataType, T.StringType) else "other") for f in df.schema}
    tested = {c: F.when(F.bool_and(F.col(c).isin("T", "F")), "boolean").otherwise("categorical") for c, k in kinds.items() if k is None}
    one = df.agg(F.count("*").alias("_rows"), *[k.alias(c) for c, k in tested.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), (F.lit(k) if k else F.col(c)).alias("kind")) for c, k in kinds.items()])))
