"""Exact quantiles from counts by value, and running sums with hot keys split by time, so that no task sorts or holds all rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.sources.records import stored


def ranges_of(df: DataFrame) -> int:
    """Into how many ranges values are dealt: as many as a shuffle has partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def place(splits: Column, value: Column, ranges: int) -> Column:
    """How many of the sorted splits (fewer than ranges) are at or below value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(ranges.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= value, at + step).otherwise(at))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls being equal; b's keys are named with an underscore before."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


#: Rows up to which a table of counts is summed up without ranges.
FEW = 100_000


def cumulated(by: DataFrame, keys: list[str], value: str, sums: list[str], few: int = FEW) -> DataFrame:
    """by, a stored table of one row for each key and value, with upto_x and all_x for each x of sums: the sum over the key's values up to the row's, and over all of them.

    Beyond few rows values are dealt over ranges between their approximate quantiles, each range is summed up by itself, and only the ranges' totals are ordered as a whole.
    """
    all_of = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if by.count() <= few:
        return by.withColumns({f"upto_{x}": F.sum(x).over(upto(all_of, value)) for x in sums} | {f"all_{x}": F.sum(x).over(all_of) for x in sums})
    ranges = ranges_of(by)
    splits = by.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    dealt = by.withColumn("_b", place(F.lit(splits), F.col(value), ranges))
    totals = dealt.groupBy(*keys, "_b").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    before = {x: F.coalesce(F.sum(f"_t_{x}").over(all_of.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for x in sums}
    starts = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("__b"), *[before[x].alias(f"_f_{x}") for x in sums], *[F.sum(f"_t_{x}").over(all_of).alias(f"all_{x}") for x in sums])
    inside = dealt.withColumns({f"_i_{x}": F.sum(x).over(upto(Window.partitionBy(*keys, "_b"), value)) for x in sums})
    on = F.col("_b") == F.col("__b")
    joined = inside.join(starts, same(inside, starts, keys) & on if keys else on)
    return joined.select(*by.columns, *[(F.col(f"_i_{x}") + F.col(f"_f_{x}")).alias(f"upto_{x}") for x in sums], *[f"all_{x}" for x in sums])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], few: int = FEW) -> DataFrame:
    """keys and a column for each wanted quantile (linear interpolation between order statistics), one row for each key; nulls are left out. Rows are reduced to counts by value, which are stored once."""
    by = stored(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "counts")
    counted = cumulated(by, keys, "_v", ["_n"], few)
    end = F.col("upto__n")

    def at(position: Column) -> Column:
        return F.max(F.when((position >= end - F.col("_n")) & (position < end), F.col("_v")))

    def made(p: float) -> Column:
        position = F.round((F.col("all__n") - 1) * F.lit(p), 9)
        low, share = at(F.floor(position)), F.max(position - F.floor(position))
        return low + (F.coalesce(at(F.floor(position) + 1), low) - low) * share

    return counted.groupBy(*keys).agg(*[made(p).alias(name) for name, p in wanted.items()])


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """grouped (one row for each key) with the quantiles of df's value by key."""
    q = quantiles(df, keys, value, wanted).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = same(grouped, q, keys) if keys else F.lit(True)  # one row each without keys
    return grouped.join(F.broadcast(q) if not keys else q, on, "left").drop(*[f"_{k}" for k in keys])


def even_parts(df: DataFrame, column: str, of: str | None = None) -> Column:
    """The number of a row's range of column (a time or a number): ranges of nearly equal numbers of df's rows, as many as a shuffle has partitions, so that no key's rows in a range are many. of: another name of the column."""
    ranges = ranges_of(df)
    number = lambda c: F.unix_micros(c) if dict(df.dtypes)[column] == "timestamp" else F.col(c).cast("double")
    splits = df.agg(F.percentile_approx(number(column), [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return place(F.lit(splits), number(of or column), ranges) if splits else F.lit(0)


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, order: tuple = ("ts", "transaction_id")) -> DataFrame:
    """df with name: the sum of value over the key's rows up to each row in the order.

    Sums are ordered within parts of the first column's range, which are made even by counting, and only the parts' totals over a whole key.
    """
    parted = df.withColumns({"_part": even_parts(df, order[0]), "_value": value})
    totals = parted.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("__part"), before.alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    own = parted.withColumn("_inside", inside)
    joined = own.join(starts, same(own, starts, keys) & (F.col("_part") == F.col("__part")))
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).select(*df.columns, name)


def so_far(df: DataFrame, sums: dict[str, tuple[tuple[str, ...], Column]], first: dict[str, tuple[str, ...]] | None = None, before: dict[str, tuple[str, ...]] | None = None, order: tuple[str, ...] = ("ts", "transaction_id")) -> DataFrame:
    """df with what stood for keys of few values, and so of many rows each, up to each row: the sum of a value (sums: keys and value), the key's first ts, and the ts of the key's row before.

    Rows are ordered within even parts of time and all keys share the one exchange by part. How a part begins for a key comes from the parts' totals, a row for each key and part, which are stored, so
    that they are broadcast where they are small. df is read once for each set of keys and should be stored; it is right for keys of many values too, but makes totals of up to df's rows.
    """
    first, before = first or {}, before or {}
    parted = df.withColumn("_part", even_parts(df, "ts"))
    inside = parted.repartition("_part")
    added, joins = {}, []
    for i, keys in enumerate(dict.fromkeys([*(k for k, _ in sums.values()), *first.values(), *before.values()])):
        of = Window.partitionBy(*keys)
        earlier = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy("_part", *keys).orderBy(*[c for c in order if c not in keys])
        totals, starts = {}, {}
        for name, value in ((n, v) for n, (k, v) in sums.items() if k == keys):
            totals[f"_t_{name}"], starts[f"_s_{name}"] = F.sum(value), F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0))
            added[name] = F.sum(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)), lambda x, n=name: x + F.col(f"_s_{n}")
        for name in (n for n, k in first.items() if k == keys):
            totals[f"_t_{name}"], starts[f"_s_{name}"] = F.min("ts"), F.min(f"_t_{name}").over(of)
            added[name] = None, lambda _, n=name: F.col(f"_s_{n}")
        for name in (n for n, k in before.items() if k == keys):
            totals[f"_t_{name}"], starts[f"_s_{name}"] = F.max("ts"), F.max(f"_t_{name}").over(earlier)
            added[name] = F.lag("ts").over(upto), lambda x, n=name: F.coalesce(x, F.col(f"_s_{n}"))
        made = parted.groupBy("_part", *keys).agg(*[a.alias(n) for n, a in totals.items()])
        renamed = made.select(F.col("_part").alias(f"_p{i}"), *[F.col(k).alias(f"_{i}_{k}") for k in keys], *[c.alias(n) for n, c in starts.items()])
        joins.append((stored(renamed, "starts"), keys, i))
    told = inside.withColumns({f"_in_{n}": x for n, (x, _) in added.items() if x is not None})
    for starts, keys, i in joins:
        on = [F.col(k).eqNullSafe(F.col(f"_{i}_{k}")) for k in keys]
        told = told.join(starts, reduce(lambda a, b: a & b, on, F.col("_part") == F.col(f"_p{i}")))
    return told.select(*df.columns, *[made(F.col(f"_in_{n}") if x is not None else None).alias(n) for n, (x, made) in added.items()])
