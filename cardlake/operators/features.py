"""Behavioural features of a transaction from what its user did before, as windows; a user's rows are brought together once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cardlake.operators.quantiles import even_parts, running_sum, same
from cardlake.sources.records import stored

TRAILING = {"1h": 3600, "6h": 6 * 3600, "24h": 86_400, "7d": 7 * 86_400}


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "transaction_id")


def before() -> WindowSpec:
    return by_user().rowsBetween(Window.unboundedPreceding, -1)


def by_day() -> WindowSpec:
    return Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "transaction_id")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(1.0))


def profile_before(txn: DataFrame) -> DataFrame:
    """Totals, the previous transaction and daily counters as they stood before each transaction.

    The daily counters are those left by the user's previous transaction, also when a new day has begun.
    """
    amount = F.col("amount")
    # one exchange serves the windows by user and those by user and day
    day = txn.repartition("user_id").withColumns({"_n": F.row_number().over(by_day()), "_sum": F.sum("amount").over(by_day().rowsBetween(Window.unboundedPreceding, 0))})
    out = day.withColumns(
        {
            "total_transactions": F.count("*").over(before()),
            "total_amount": F.coalesce(F.sum(amount).over(before()), F.lit(0.0)),
            "last_ts": F.lag("ts").over(by_user()),
            "last_amount": F.coalesce(F.lag(amount).over(by_user()), F.lit(0.0)),
            "max_amount_before": F.coalesce(F.max(amount).over(before()), F.lit(0.0)),
            "daily_count": F.coalesce(F.lag("_n").over(by_user()), F.lit(0)),
            "daily_amount": F.coalesce(F.lag("_sum").over(by_user()), F.lit(0.0)),
        }
    ).drop("_n", "_sum")
    gap = (F.unix_micros("ts") - F.unix_micros("last_ts")) / 1e6
    n = F.col("total_transactions")
    return out.withColumns({"avg_amount": F.when(n > 0, F.col("total_amount") / n).otherwise(0.0), "gap_seconds": F.coalesce(gap, F.lit(0.0))})


def risk_features(profiled: DataFrame, high_amount: float = 150.0, rapid_seconds: float = 300.0) -> DataFrame:
    """Ratios, flags and velocity."""
    hour = F.hour("ts")
    return profiled.withColumns(
        {
            "hour": hour,
            "weekday": F.weekday("ts"),
            "amount_vs_avg": ratio(F.col("amount"), F.col("avg_amount")),
            "amount_vs_last": ratio(F.col("amount"), F.col("last_amount")),
            "is_high_amount": F.col("amount") > high_amount,
            "is_unusual_hour": (hour < 6) | (hour > 22),
            "is_rapid": F.col("gap_seconds") < rapid_seconds,
            "velocity": F.col("daily_count") / 24.0,
        }
    )


def trailing(txn: DataFrame, name: str, seconds: int) -> DataFrame:
    """count, sum, average, maximum, minimum and deviation of a user's amounts in the seconds up to each transaction, and its products. txn has _us, the time in microseconds, so that all lengths share one sort."""
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    a = F.col("amount")
    return txn.withColumns(
        {
            f"count_{name}": F.count("*").over(w),
            f"sum_{name}": F.sum(a).over(w),
            f"avg_{name}": F.avg(a).over(w),
            f"max_{name}": F.max(a).over(w),
            f"min_{name}": F.min(a).over(w),
            f"std_{name}": F.stddev_pop(a).over(w),
            f"per_hour_{name}": F.sum(a).over(w) / (seconds / 3600),
            f"products_{name}": F.size(F.collect_set("product").over(w)),
        }
    )


def first_seen(*key: str) -> Column:
    """1 on the first row of a key in time, else 0; its running sum counts distinct keys."""
    return (F.row_number().over(Window.partitionBy(*key).orderBy("ts", "transaction_id")) == 1).cast("int")


def in_time(*key: str, order: tuple[str, ...] = ("ts", "transaction_id")) -> WindowSpec:
    """A key's rows up to each of them, in time. Columns of order before the time may be such as never fall with it, so that windows share a sort."""
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def rank_before(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows (transaction_id, ts, key, value) with earlier, how many of the key's rows came before each, and smaller, how many of these had a smaller value; rows with a null value count as earlier only.

    Offline dominance counting: rows are numbered by time from 0; any two of a key first differ in one binary place of their numbers, from the top, and there the later one has 1. So for each place the rows
    that agree above it are put in order of value, and the rows with 1 count those with 0 before them. All places go through one exchange; each row takes part in as many as the largest number has.
    """
    numbered = stored(running_sum(rows, [key], F.lit(1), "_n").withColumn("_n", (F.col("_n") - 1).cast("long")), "numbered")
    places = max(1, int(numbered.agg(F.max("_n")).first()[0] or 0).bit_length())
    at = numbered.filter(F.col(value).isNotNull()).select("transaction_id", key, value, "_n", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("_place"))
    one = F.expr("shiftright(_n, _place) & 1")
    block = at.select("transaction_id", key, value, "_place", F.expr("shiftright(_n, _place + 1)").alias("_block"), one.cast("int").alias("_late"), (-one).cast("int").alias("_first"))
    counted = running_sum(block, [key, "_place", "_block"], 1 - F.col("_late"), "_below", (value, "_first"))
    smaller = counted.filter("_late = 1").groupBy("transaction_id").agg(F.sum("_below").alias("smaller"))
    return numbered.join(smaller, "transaction_id", "left").select(*rows.columns, F.col("_n").alias("earlier"), F.coalesce("smaller", F.lit(0)).alias("smaller"))


def as_of(rows: DataFrame, log: DataFrame, since: str, value: str, keys: tuple[str, ...] = (), tie: str | None = None, strict: bool = False) -> DataFrame:
    """rows (with ts) and the log's value as it stood at each row's time, by keys; null before the first entry. strict: entries of the row's own time come too late. tie: orders entries of one time.

    Both sides are merged by time in even parts: within a part the last entry before a row is found by a window, and a part begins with the last entry of the key's parts before it; so no key is one task's.
    """
    entry = F.struct(F.col(value).alias("v"))
    kind = log.select(entry.alias("e")).schema["e"].dataType
    rank = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    asked, told = (0, 1) if strict else (1, 0)
    left = rows.withColumns({"_t": F.col("ts"), "_is": F.lit(asked), "_tie": F.lit(None).cast("long"), "_e": F.lit(None).cast(kind)})
    right = log.select(*keys, F.col(since).alias("_t"), F.lit(told).alias("_is"), rank.alias("_tie"), entry.alias("_e"))
    parted = left.unionByName(right, allowMissingColumns=True).withColumn("_part", even_parts(rows, "ts", of="_t"))
    last = parted.groupBy(*keys, "_part").agg(F.max_by("_e", F.when(F.col("_is") == told, F.struct("_t", "_tie"))).alias("_last"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a part
    begin = F.last("_last", True).over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), begin.alias("_begin"))
    inside = F.last("_e", True).over(Window.partitionBy(*keys, "_part").orderBy("_t", "_is", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    found = parted.withColumn("_inside", inside).filter(F.col("_is") == asked)
    on = F.col("_part") == F.col("_p")
    joined = found.join(begins, same(found, begins, list(keys)) & on if keys else on)
    return joined.withColumn(value, F.coalesce("_inside", "_begin")["v"]).select(*rows.columns, value)


def hash_code(column: str, codes: int = 1000) -> Column:
    """A category as a number below codes, from 48 bits of a hash that other engines have too; a missing one is `unknown`."""
    digest = F.md5(F.coalesce(F.col(column), F.lit("unknown")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(codes)).cast("int")
