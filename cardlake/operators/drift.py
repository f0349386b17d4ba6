"""Distribution drift between reference and current rows (boolean is_reference), reduced to bins or distinct values before any window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators.quantiles import FEW, cumulated
from cardlake.operators.stats import chi_square_p, ks_p, normal_p, t_p
from cardlake.sources.records import stored

EPSILON = 1e-8


def _sides() -> tuple[Column, Column]:
    return F.count_if(F.col("is_reference")), F.count_if(~F.col("is_reference"))


def shares(df: DataFrame, key: str | Column, epsilon: float = EPSILON) -> DataFrame:
    """r and c: each value's share of the reference and of the current rows, epsilon at least."""
    r, c = _sides()
    total = df.agg(r.alias("nr"), c.alias("nc"))
    counts = df.groupBy(key).agg(r.alias("r"), c.alias("c")).crossJoin(F.broadcast(total))  # one row
    return counts.withColumns({"r": F.greatest(F.col("r") / F.col("nr"), F.lit(epsilon)), "c": F.greatest(F.col("c") / F.col("nc"), F.lit(epsilon))})


def psi_numeric(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability over equal bins of the reference's range; rows outside count in the totals only."""
    x = F.col(column)
    r, c = _sides()
    limits = df.agg(F.min(F.when(F.col("is_reference"), x)).alias("lo"), F.max(F.when(F.col("is_reference"), x)).alias("hi"), r.alias("nr"), c.alias("nc"))
    widened = F.col("lo") == F.col("hi")
    limits = limits.select(F.when(widened, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(widened, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "nr", "nc")
    limits = limits.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    inside = df.crossJoin(F.broadcast(limits)).filter(x.between(F.col("lo"), F.col("hi")))  # one row
    binned = inside.groupBy(F.least(F.floor((x - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(r.alias("r"), c.alias("c"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(limits))
    part = lambda n, of: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(of), F.lit(EPSILON))
    both = grid.join(binned, "bin", "left").select(part("r", "nr").alias("r"), part("c", "nc").alias("c"))
    return both.agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def jensen_shannon(df: DataFrame, key: str) -> DataFrame:
    term = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(2 * F.col(a) / (F.col("r") + F.col("c")))).otherwise(0.0)
    return shares(df, key, 0.0).agg(F.sqrt(F.lit(0.5) * F.sum(term("r") + term("c"))).alias("distance"))


def kolmogorov_smirnov(df: DataFrame, column: str, few: int = FEW) -> DataFrame:
    """The largest distance of the two sides' cumulative shares, from counts by value; no task sorts more than few of them."""
    r, c = _sides()
    by = cumulated(stored(df.groupBy(column).agg(r.alias("r"), c.alias("c")), "counts"), [], column, ["r", "c"], few)
    return by.agg(F.max(F.abs(F.col("upto_r") / F.col("all_r") - F.col("upto_c") / F.col("all_c"))).alias("d"))


def two_proportions(df: DataFrame, flag: str) -> DataFrame:
    """The difference of a flag's rates and its pooled z."""
    r, c = _sides()
    rate = lambda side: F.avg(F.when(side, F.col(flag)))
    one = df.agg(rate(F.col("is_reference")).alias("pr"), rate(~F.col("is_reference")).alias("pc"), F.avg(flag).alias("p"), r.alias("nr"), c.alias("nc"))
    d = F.col("pc") - F.col("pr")
    return one.select(d.alias("difference"), (d / F.sqrt(F.col("p") * (1 - F.col("p")) * (1 / F.col("nr") + 1 / F.col("nc")))).alias("z"))


def concept_test(df: DataFrame, flag: str, least: int = 50, difference: float = 0.01, level: float = 0.05) -> DataFrame:
    """two_proportions with the tail p and is_alert."""
    one = two_proportions(df, flag).crossJoin(df.agg(F.count_if(~F.col("is_reference")).alias("_n")))  # one row each
    return one.withColumn("p", normal_p(F.col("z"))).withColumn("is_alert", (F.col("_n") >= least) & (F.abs("difference") > difference) & (F.col("p") < level)).drop("_n")


def chi_square(df: DataFrame, column: str) -> DataFrame:
    """statistic and categories of the counts by side and value, one row; Yates's correction where there are two values. No window: totals come from an aggregate of the counts."""
    both = df.groupBy(F.col(column).alias("_value")).agg(*[c.alias(n) for n, c in zip("rc", _sides(), strict=True)])
    total = both.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"), F.count("*").alias("categories"))
    n = F.col("r") + F.col("c")
    share = F.col("tr") / (F.col("tr") + F.col("tc"))
    less = F.when(F.col("categories") == 2, 0.5).otherwise(0.0)
    term = lambda o, e: (lambda d: d * d / e)(F.greatest(F.abs(o - e) - less, F.lit(0.0)))
    cells = both.crossJoin(F.broadcast(total))  # one row
    return cells.agg(F.sum(term(F.col("r"), n * share) + term(F.col("c"), n * (1 - share))).alias("statistic"), F.max("categories").alias("categories"))


def common_features(reference: tuple[str, ...], current: tuple[str, ...], least: float = 0.8) -> list[str]:
    """The features both sides have, sorted; an error where they are less than least of the reference's."""
    both = sorted(set(reference) & set(current))
    if len(both) < least * len(set(reference)):
        raise ValueError(f"only {len(both)} of {len(set(reference))} features are in both sets")
    return both


#: By test: the values from which drift is medium, high and critical, and that over which to train anew.
LEVELS = {"psi": ((0.1, 0.25, 0.5), 0.25), "performance": ((0.05, 0.1, 0.2), 0.1), "feature": ((0.1, 0.2, 0.4), 0.3), "concept": ((0.1, 0.2, 0.4), 0.02)}
ADVICE = {
    "psi": ("compare the sources of the feature", "train on current rows"),
    "performance": ("check the latest labels", "train on current rows"),
    "feature": ("check how the feature is made", "watch the feature"),
    "concept": ("look for new kinds of fraud", "train on current labels"),
}


def counts_by_value(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """feature, number or text, and how many reference (r) and current rows (c) have it, of all features from one pass; null numbers are left out, null texts are a value. Stored, as all tests read it."""
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for f in numeric]
    rows += [F.struct(F.lit(f).alias("feature"), F.lit(None).cast("double").alias("number"), F.col(f).cast("string").alias("text")) for f in categorical]
    r, c = _sides()
    by = df.select("is_reference", F.inline(F.array(*rows))).groupBy("feature", "number", "text").agg(r.alias("r"), c.alias("c"))
    return stored(by.filter(~F.col("feature").isin(*numeric) | F.col("number").isNotNull() & ~F.isnan("number")), "drift-counts")


def psi_by_feature(counts: DataFrame, bins: int = 10) -> DataFrame:
    """feature and psi of numeric features, over equal bins of each one's reference range."""
    seen = F.when(F.col("r") > 0, F.col("number"))
    limits = counts.groupBy("feature").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    one = F.col("lo") == F.col("hi")
    limits = limits.select("feature", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "nr", "nc")
    limits = F.broadcast(limits.withColumn("w", (F.col("hi") - F.col("lo")) / bins))  # a row for each feature named
    inside = counts.join(limits, "feature").filter(F.col("number").between(F.col("lo"), F.col("hi")))
    at = F.least(F.floor((F.col("number") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    binned = inside.groupBy("feature", at.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    grid = limits.select("feature", "nr", "nc", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    part = lambda n, of: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(of), F.lit(EPSILON))
    both = grid.join(binned, ["feature", "bin"], "left").select("feature", part("r", "nr").alias("r"), part("c", "nc").alias("c"))
    return both.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def categorical_tests(counts: DataFrame) -> DataFrame:
    """feature, psi, jensen_shannon, statistic (chi-square, Yates's correction for two values) and categories of categorical features."""
    totals = counts.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.count("*").alias("k"))
    cells = counts.join(F.broadcast(totals), "feature")  # a row for each feature named
    p, q = F.col("r") / F.col("nr"), F.col("c") / F.col("nc")
    a, b = F.greatest(p, F.lit(EPSILON)), F.greatest(q, F.lit(EPSILON))
    js = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(0.0)
    n, share = F.col("r") + F.col("c"), F.col("nr") / (F.col("nr") + F.col("nc"))
    less = F.when(F.col("k") == 2, 0.5).otherwise(0.0)
    chi = lambda o, e: (lambda d: d * d / e)(F.greatest(F.abs(o - e) - less, F.lit(0.0)))
    return cells.groupBy("feature").agg(
        F.sum((b - a) * F.log(b / a)).alias("psi"),
        F.sqrt(F.lit(0.5) * F.sum(js(p) + js(q))).alias("jensen_shannon"),
        F.sum(chi(F.col("r"), n * share) + chi(F.col("c"), n * (1 - share))).alias("statistic"),
        F.max("k").alias("categories"),
    )


def alert_rows(df: DataFrame, ends: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], label: str, psi_limit: float = 0.05, p_limit: float = 0.05, chi_p_limit: float = 0.15, js_limit: float = 0.1, least: int = 50, few: int = FEW) -> DataFrame:
    """test, kind, feature, value, p, severity, is_alert, confidence, retrain and advice of every test. ends: one row of metrics.head_tail.

    df is read once, for counts by feature, value and side; every test follows from these.
    """
    counts = counts_by_value(df, (*numeric, label), categorical)
    named, texts = counts.filter(F.col("feature").isin(*numeric)), counts.filter(F.col("feature").isin(*categorical))

    def rows(found: DataFrame, test: str, kind: str, value: Column, p: Column, alert: Column) -> DataFrame:
        (a, b, c), again = LEVELS[kind]
        kept = found.select("feature", value.cast("double").alias("value"), p.cast("double").alias("p"), F.coalesce(alert, F.lit(False)).alias("is_alert"))
        v = F.col("value")
        level = F.when(v >= c, "critical").when(v >= b, "high").when(v >= a, "medium").otherwise("low")
        sure = F.coalesce(1 - F.col("p"), F.least(v / c, F.lit(1.0)))
        return kept.select(F.lit(test).alias("test"), F.lit(kind).alias("kind"), "feature", "value", "p", level.alias("severity"), "is_alert", sure.alias("confidence"),
                           (F.col("is_alert") & (v > again)).alias("retrain"), F.array(*map(F.lit, ADVICE[kind])).alias("advice"))

    none = F.lit(None)
    c = cumulated(named, ["feature"], "number", ["r", "c"], few)
    apart = F.max(F.abs(F.col("upto_r") / F.col("all_r") - F.col("upto_c") / F.col("all_c")))
    ks = c.groupBy("feature").agg(apart.alias("d"), F.max("all_r").cast("double").alias("n"), F.max("all_c").cast("double").alias("m")).withColumn("p", ks_p(F.col("d"), F.col("n"), F.col("m")))
    cats = stored(categorical_tests(texts), "drift-categories").withColumn("p", chi_square_p(F.col("statistic"), F.col("categories") - 1))
    psi = psi_by_feature(named).unionByName(cats.select("feature", "psi"))
    sums = counts.filter(F.col("feature") == label).groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.sum(F.col("r") * F.col("number")).alias("pr"), F.sum(F.col("c") * F.col("number")).alias("pc"))
    rate, d = (F.col("pr") + F.col("pc")) / (F.col("nr") + F.col("nc")), F.col("pc") / F.col("nc") - F.col("pr") / F.col("nr")
    concept = sums.select("feature", "nc", d.alias("d"), (d / F.sqrt(rate * (1 - rate) * (1 / F.col("nr") + 1 / F.col("nc")))).alias("z")).withColumn("p", normal_p(F.col("z")))
    drop = F.col("head") - F.col("tail")
    t = ends.select(F.lit("accuracy").alias("feature"), drop.alias("drop"), F.try_divide(drop, F.sqrt((F.col("head_var") + F.col("tail_var")) / F.col("m"))).alias("t"), "m").withColumn("p", t_p(F.col("t"), 2 * F.col("m") - 2))
    parts = (
        rows(psi, "psi", "psi", F.col("psi"), none, F.col("psi") > psi_limit),
        rows(ks, "kolmogorov_smirnov", "feature", F.col("d"), F.col("p"), F.col("p") < p_limit),
        rows(cats, "chi_square", "feature", F.try_divide("statistic", 2 * F.col("categories")), F.col("p"), F.col("p") < chi_p_limit),
        rows(cats, "jensen_shannon", "feature", F.col("jensen_shannon"), none, F.col("jensen_shannon") > js_limit),
        rows(concept, "two_proportions", "concept", F.abs("d"), F.col("p"), (F.col("nc") >= least) & (F.abs("d") > 0.01) & (F.col("p") < p_limit)),
        rows(t, "head_and_tail", "performance", F.col("drop"), F.col("p"), F.col("drop") > LEVELS["performance"][0][0]),
    )
    return reduce(DataFrame.unionByName, parts)
