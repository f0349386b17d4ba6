"""How well scores tell the label, from counts by distinct score; and how two scores of the same rows differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators.quantiles import FEW, cumulated
from cardlake.operators.stats import ks_p, normal_cdf
from cardlake.sources.records import stored


def curve(df: DataFrame, keys: list[str], score: str, label: str, few: int = FEW) -> DataFrame:
    """keys and, for each distinct score from the highest down: n rows and p positives of it, said rows and hit positives of it or higher, and all of either. Exact: scores are not rounded. Null scores are left out."""
    by = df.filter(F.col(score).isNotNull()).groupBy(*keys, (-F.col(score).cast("double")).alias("_s")).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    names = {"upto_n": "said", "upto_p": "hit"}
    return cumulated(stored(by, "scores"), keys, "_s", ["n", "p"], few).withColumnsRenamed(names)


def average_precision(df: DataFrame, score: str, label: str, few: int = FEW) -> DataFrame:
    return curve(df, [], score, label, few).agg(F.sum(F.col("p") / F.col("all_p") * F.col("hit") / F.col("said")).alias("ap"))


def recall_at_fpr(df: DataFrame, score: str, label: str, fpr: float = 0.01, few: int = FEW) -> DataFrame:
    """The largest recall of a threshold whose false positive rate is at most fpr; 0 if none is."""
    allowed = (F.col("said") - F.col("hit")) / (F.col("all_n") - F.col("all_p")) <= fpr
    return curve(df, [], score, label, few).agg(F.coalesce(F.max(F.when(allowed, F.col("hit") / F.col("all_p"))), F.lit(0.0)).alias("recall"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.round(score, 6) * bins), F.lit(bins - 1))
    by = df.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(label).alias("p"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("p"))) / F.sum("n")).alias("error"))


def comparison(df: DataFrame, a: str, b: str, cut: float = 0.5) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    side = lambda c: F.round(c, 6) >= cut
    return df.agg(
        F.max(d).alias("max_difference"),
        F.avg(d).alias("mean_difference"),
        F.stddev_pop(d).alias("std_difference"),
        F.corr(a, b).alias("correlation"),
        F.avg((side(a) == side(b)).cast("int")).alias("agreement"),
        F.count_if(side(a) & ~side(b)).alias("only_first"),
        F.count_if(~side(a) & side(b)).alias("only_second"),
    )


def ranked(df: DataFrame, key: str, label: str) -> DataFrame:
    """df with _rank (from 1) of each row among its label's in order of the key's hash, and _all, their number. Ranks come from 65,536 hash ranges, so no label is sorted in one task."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    coded = df.withColumns({"_h": digest, "_b": F.substring(digest, 1, 4)})
    sizes = coded.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(label, "_b", before.alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    return coded.join(starts, [label, "_b"]).withColumn("_rank", rank).drop("_h", "_b", "_before")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8) -> DataFrame:
    """df with in_training: the first share of each label's rows in order of the key's hash."""
    return ranked(df, key, label).withColumn("in_training", F.col("_rank") <= F.floor(share * F.col("_all"))).drop("_rank", "_all")


def mutual_information(df: DataFrame, feature: str, label: str) -> DataFrame:
    """In nats, from the contingency table of two discrete columns."""
    cells = df.groupBy(feature, label).agg(F.count("*").alias("n"))
    f, y, every = (F.sum("n").over(Window.partitionBy(*k)) for k in ([feature], [label], [F.lit(0)]))
    return cells.select("n", f.alias("f"), y.alias("y"), every.alias("t")).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("f") * F.col("y")))).alias("mi"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean and t of the differences of two columns."""
    d = F.col(a) - F.col(b)
    one = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))
    return one.select("n", "mean", (F.col("mean") / (F.col("std") / F.sqrt("n"))).alias("t"))


def mutual_information_by(df: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """feature and mi, in nats, of many discrete features in long form."""
    cells = df.groupBy(feature, value, label).agg(F.count("*").alias("n"))
    v, y, every = (F.sum("n").over(Window.partitionBy(*k)) for k in ([feature, value], [feature, label], [feature]))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("v") * F.col("y")))
    return cells.withColumns({"v": v, "y": y, "t": every}).groupBy(feature).agg(F.sum(term).alias("mi"))


def auc(df: DataFrame, score: str, label: str, few: int = FEW) -> DataFrame:
    """The exact area under the curve, equal scores counted half; null without both labels."""
    return _area(curve(df, [], score, label, few), [])


def _area(c: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.sum((F.col("n") - F.col("p")) * (F.col("hit") - F.col("p") / 2))
    return c.groupBy(*keys).agg(F.try_divide(pairs, F.max(F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("auc"))


def cells(said: Column, true: Column) -> list[Column]:
    """tp, tn, fp and fn of a decision against the truth, as aggregates."""
    return [F.count_if(c).alias(n) for n, c in {"tp": said & true, "tn": ~said & ~true, "fp": said & ~true, "fn": ~said & true}.items()]


def rates() -> dict[str, Column]:
    """Metrics of the columns tp, tn, fp and fn; one without rows to count is 0."""
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    part = lambda a, b: a / F.greatest(b, F.lit(1))
    return {"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "accuracy": part(tp + tn, tp + tn + fp + fn), "fpr": part(fp, fp + tn), "fnr": part(fn, tp + fn)}


def auc_by(df: DataFrame, keys: list[str], score: str, label: str, few: int = FEW) -> DataFrame:
    """keys and the exact auc of each, equal scores counted half; null without both labels."""
    return _area(curve(df, keys, score, label, few), keys)


def normal_distance(df: DataFrame, value: Column, few: int = FEW) -> DataFrame:
    """n, d and p of the one-sample Kolmogorov-Smirnov test of value against a standard normal law: the larger of both one-sided distances, from counts by value; p is the asymptotic tail."""
    by = stored(df.select(value.cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("n")), "values")
    c, law = cumulated(by, [], "_v", ["n"], few), normal_cdf(F.col("_v"))
    above, below = F.col("upto_n") / F.col("all_n") - law, law - (F.col("upto_n") - F.col("n")) / F.col("all_n")
    one = c.agg(F.max("all_n").alias("n"), F.max(F.greatest(above, below)).alias("d"))
    return one.withColumn("p", ks_p(F.col("d"), 2.0 * F.col("n"), 2.0 * F.col("n")))  # two samples of 2n are as one of n
