"""Profile of a table as one nested document: numbers, categories with their most frequent values, and time.

Most frequent values of all columns come from one pass with a mergeable sketch of bounded size each, which names candidates, and one that counts these exactly. A value the sketch lost occurs at most
ERROR times the rows over the sketch's size; where the last wanted count is not above that bound, the columns in question are counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.sources.records import stored

#: Items of a sketch, candidates taken from it, and the sketch's largest error as a multiple of rows over items.
TRACKED, CANDIDATES, ERROR = 8192, 512, 3.5
NUMBERS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
VALUES = "array<struct<value: string, n: bigint, share: double>>"


def top_values(df: DataFrame, columns: tuple[str, ...], k: int = 10, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """key, value, n, share and rank of each column's k most frequent values, nulls left out, equal counts by value; exact."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sketch = texts.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_{c}") for c in columns], *[F.expr(f"approx_top_k(`{c}`, {min(candidates, tracked)}, {tracked})").alias(c) for c in columns])
    one = stored(sketch.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"_{c}").alias("there"), F.transform(c, lambda x: x["item"]).alias("items")) for c in columns]))), "sketches")
    rows = one.agg(F.max("_n")).first()[0] or 0
    named = one.select("key", F.explode("items").alias("value")).filter("value is not null")  # columns times candidates at most
    long = texts.unpivot([], list(columns), "key", "value").filter("value is not null")
    exact = stored(long.join(F.broadcast(named), ["key", "value"]).groupBy("key", "value").agg(F.count("*").alias("n")), "top-values")
    sized = exact.groupBy("key").agg(F.sum("n").alias("held"), F.get(F.sort_array(F.collect_list("n"), asc=False), F.lit(k - 1)).alias("kth"))  # candidates only
    # a column is settled if the candidates are all its values, or none that the sketch lost can be among the first k
    both = one.select("key", "there").join(sized, "key", "left").collect()
    unsure = [r["key"] for r in both if r["held"] != r["there"] and r["there"] and (r["kth"] or 0) <= ERROR * rows / tracked]
    if unsure:
        full = long.filter(F.col("key").isin(*unsure)).groupBy("key", "value").agg(F.count("*").alias("n"))
        exact = exact.filter(~F.col("key").isin(*unsure)).unionByName(full)
    salted = exact.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.desc("n"), F.asc("value")]
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("key", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= k).select("key", "value", "n", (F.col("n") / rows).alias("share"), "rank")


def sections(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], time: str, label: str, k: int = 10) -> DataFrame:
    """One row: metadata, numeric (by column its metrics), categorical (missing, distinct and the first k values), time (first, last, rows and rate of label by hour)."""
    one = df.agg(
        F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"),
        *[f(c).cast("double").alias(f"{c}:{m}") for c in numeric for m, f in NUMBERS.items()],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}:missing") for c in categorical],
    )
    metric = lambda c: F.map_from_arrays(F.array(*map(F.lit, NUMBERS)), F.array(*[F.col(f"`{c}:{m}`") for m in NUMBERS]))
    top = top_values(df, categorical, k).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value", "n", "share"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"), x["share"].alias("share"))).alias("values"))
    tops = top.agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("_top"))  # k values of each column named
    hours = df.groupBy(F.hour(time).alias("hour")).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    by_hour = hours.agg(F.sort_array(F.collect_list(F.struct("hour", "n", "rate"))).alias("_hours"))  # 24 rows
    category: dict[str, Column] = {c: F.struct(F.col(f"`{c}:missing`").alias("missing"), F.coalesce(F.col("_top")[c], F.array().cast(VALUES)).alias("values")) for c in categorical}
    both = one.crossJoin(F.broadcast(tops)).crossJoin(F.broadcast(by_hour))  # one row each
    return both.select(
        F.struct("rows", F.lit("1").alias("version")).alias("metadata"),
        F.map_from_arrays(F.array(*map(F.lit, numeric)), F.array(*map(metric, numeric))).alias("numeric"),
        F.map_from_arrays(F.array(*map(F.lit, categorical)), F.array(*category.values())).alias("categorical"),
        F.struct("first", "last", F.col("_hours").alias("by_hour")).alias("time"),
    )
