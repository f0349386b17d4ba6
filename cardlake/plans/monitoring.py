"""Registered queries on profiling, feedback, evaluation, drift alerts, experiments and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators import alerts as al
from cardlake.operators import drift, evaluation, experiments, feedback
from cardlake.operators.quantiles import quantiles, running_sum, with_quantiles
from cardlake.plans import sql
from cardlake.plans.queries import _PSI, _SIDES, ORACLE, QUERIES, alerts, query, r6, scored
from cardlake.sources.tables import transactions

FEEDBACK = (
    sql.ALERTS
    + """,
fb AS (SELECT transaction_id, user_id, i, (transaction_id * 7 + i) % 11 AS investigator, CASE WHEN (k + i) % 4 < 2 THEN 'fraud' ELSE 'legitimate' END AS label,
       0.6::DOUBLE + 0.04::DOUBLE * ((transaction_id + i) % 10) AS confidence, 1 + (transaction_id + 3 * i) % 8 AS minutes, fraud_score AS prediction,
       0.4::DOUBLE + 0.06::DOUBLE * ((transaction_id * 7 + i) % 11) AS accuracy, ts + (1 + i) * INTERVAL 1 HOUR AS given FROM alerts, (VALUES (0), (1), (2)) v(i) WHERE i <= k % 3)"""
)
FEATURES = ("amount", "k", "addr1")
_LONG = sql.TXN + ", long AS (" + " UNION ALL ".join(f"SELECT transaction_id, is_fraud, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM txn" for f in FEATURES) + ")"


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("transaction_id", "is_fraud", *[F.col(f).cast("double") for f in FEATURES])
    return t.unpivot(["transaction_id", "is_fraud"], list(FEATURES), "feature", "value")


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.of_alerts(alerts(spark, sf_dir))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumn("is_reference", F.col("ts") < "2024-01-16")


# ---- profiling ----


@query("SELECT transaction_id, feature, value FROM long", _LONG)
def features_wide_to_long(spark, sf_dir):
    return long_features(spark, sf_dir).drop("is_fraud")


@query("SELECT is_fraud, count(*) AS n, round(count(*) / (SELECT count(*) FROM txn)::DOUBLE, 6) AS share, round(avg(amount), 6) AS mean, round(median(amount), 6) AS median FROM txn GROUP BY 1")
def class_comparison(spark, sf_dir):
    t = transactions(spark, sf_dir)
    by = t.groupBy("is_fraud").agg(F.count("*").alias("n"), r6(F.avg("amount")).alias("mean"))
    by = with_quantiles(by, t, ["is_fraud"], "amount", {"median": 0.5}).withColumn("median", r6("median"))
    return by.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


RANGES = ((0, 10), (10, 50), (50, 100), (100, 500), (500, 1000), (1000, 5000), (5000, 1e18))


@query(f"""SELECT lo, count(transaction_id) AS n, coalesce(sum(is_fraud), 0)::BIGINT AS frauds, round(avg(is_fraud), 6) AS rate FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in RANGES)}) r(lo, hi)
       LEFT JOIN txn ON amount <= hi AND (amount > lo OR (lo = 0 AND amount = 0)) GROUP BY 1""")  # fmt: skip
def rate_by_amount_range(spark, sf_dir):
    a = F.col("amount")
    lo = F.lit(None).cast("double")
    for low, high in reversed(RANGES):
        lo = F.when((a <= high) & (a >= 0), float(low)).otherwise(lo)
    by = transactions(spark, sf_dir).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.sum("is_fraud").alias("frauds"), r6(F.avg("is_fraud")).alias("rate"))
    grid = spark.createDataFrame([(float(low),) for low, _ in RANGES], "lo double")
    return grid.join(by, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("frauds", F.lit(0)).alias("frauds"), "rate")


@query("""SELECT feature, round(abs((f - l) / l), 6) AS difference FROM (SELECT feature, avg(value) FILTER (WHERE is_fraud = 1) AS f, avg(value) FILTER (WHERE is_fraud = 0) AS l FROM long
       GROUP BY 1 HAVING count(value) FILTER (WHERE is_fraud = 1) > 100 AND count(value) FILTER (WHERE is_fraud = 0) > 100) ORDER BY difference DESC, feature LIMIT 20""", _LONG)  # fmt: skip
def feature_mean_difference(spark, sf_dir):
    of = lambda y: F.when(F.col("is_fraud") == y, F.col("value"))
    by = long_features(spark, sf_dir).groupBy("feature").agg(F.avg(of(1)).alias("f"), F.avg(of(0)).alias("l"), F.count(of(1)).alias("nf"), F.count(of(0)).alias("nl"))
    return by.filter("nf > 100 and nl > 100").select("feature", r6(F.abs((F.col("f") - F.col("l")) / F.col("l"))).alias("difference")).orderBy(F.desc("difference"), "feature").limit(20)


@query("SELECT round(quantile_cont(amount, 0.75) FILTER (WHERE is_fraud = 1) / quantile_cont(amount, 0.75) FILTER (WHERE is_fraud = 0), 6) AS ratio FROM txn")
def risk_ratio(spark, sf_dir):
    q = quantiles(transactions(spark, sf_dir), ["is_fraud"], "amount", {"q75": 0.75})
    of = lambda y: F.max(F.when(F.col("is_fraud") == y, F.col("q75")))
    return q.agg(r6(of(1) / of(0)).alias("ratio"))


@query("SELECT hour(ts)::INT AS hour, count(*) AS n, round(avg(is_fraud), 6) AS rate FROM txn GROUP BY 1 HAVING round(avg(is_fraud), 6) > round(1.2::DOUBLE * (SELECT avg(is_fraud) FROM txn), 6)")
def risky_hours(spark, sf_dir):
    by = transactions(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("is_fraud").alias("p"))
    every = Window.partitionBy(F.lit(0))  # 24 rows
    overall = F.sum("p").over(every) / F.sum("n").over(every)
    return by.withColumns({"rate": r6(F.col("p") / F.col("n")), "limit": r6(1.2 * overall)}).filter(F.col("rate") > F.col("limit")).select("hour", "n", "rate")


@query("SELECT hour(ts)::INT AS hour, round(avg(is_fraud), 6) AS rate FROM txn GROUP BY 1 ORDER BY rate DESC, hour LIMIT 1")
def peak_risk_hour(spark, sf_dir):
    by = transactions(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(r6(F.avg("is_fraud")).alias("rate"))
    return by.orderBy(F.desc("rate"), "hour").limit(1)


@query("""SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, round(1 - count(value) / count(*)::DOUBLE, 6) AS missing FROM long GROUP BY 1 HAVING count(value) > 1000""", _LONG)  # fmt: skip
def numeric_distributions(spark, sf_dir):
    v = F.col("value")
    long = long_features(spark, sf_dir)
    by = long.groupBy("feature").agg(r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), r6(1 - F.count(v) / F.count("*")).alias("missing"), F.count(v).alias("_n"))
    q = {f"q{n}": n / 100 for n in (25, 50, 75)}
    return with_quantiles(by.filter("_n > 1000").drop("_n"), long, ["feature"], "value", q).withColumns({c: r6(c) for c in q})


@query("SELECT round(skewness(amount), 4) AS skewness, round(kurtosis(amount), 4) AS kurtosis FROM txn WHERE ts < TIMESTAMP '2024-01-16'")
def baseline_shape(spark, sf_dir):
    n, g1, g2 = F.count("amount"), F.skewness("amount"), F.kurtosis("amount")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return transactions(spark, sf_dir).filter("ts < '2024-01-16'").agg(F.round(g1 * F.sqrt(n * (n - 1)) / (n - 2), 4).alias("skewness"), F.round(adjusted, 4).alias("kurtosis"))


@query("""SELECT count(*) AS n, round(sum(amount), 6) AS sum, min(amount) AS min, max(amount) AS max, round(avg(amount), 6) AS mean, round(stddev_pop(amount), 6) AS std, round(quantile_cont(amount, 0.5), 6) AS p50,
       round(quantile_cont(amount, 0.95), 6) AS p95, round(quantile_cont(amount, 0.99), 6) AS p99 FROM txn WHERE ts > (SELECT max(ts) FROM txn) - INTERVAL 86400 SECOND""")  # fmt: skip
def metric_summary(spark, sf_dir):
    t, a = transactions(spark, sf_dir), F.col("amount")
    recent = t.crossJoin(F.broadcast(t.agg(F.max("ts").alias("as_of")))).filter(F.col("ts") > F.col("as_of") - F.expr("interval 86400 seconds"))  # one row
    one = recent.agg(F.count("*").alias("n"), r6(F.sum(a)).alias("sum"), F.min(a).alias("min"), F.max(a).alias("max"), r6(F.avg(a)).alias("mean"), r6(F.stddev_pop(a)).alias("std"))
    q = {f"p{n}": n / 100 for n in (50, 95, 99)}
    return with_quantiles(one, recent, [], "amount", q).withColumns({c: r6(c) for c in q})


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(avg(fraud_score), 6) AS mean_score, round(sum(amount), 4) AS amount FROM scored GROUP BY 1", sql.SCORED)
def mergeable_aggregate_state(spark, sf_dir):
    hourly = scored(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("fraud_score").alias("s"), F.sum("amount").alias("a"))
    return hourly.groupBy(F.to_date("hour").alias("date")).agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("mean_score"), F.round(F.sum("a"), 4).alias("amount"))


@query("SELECT severity, product, count(*) AS n FROM alerts GROUP BY 1, 2", sql.ALERTS)
def labelled_counters(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("severity", "product").agg(F.count("*").alias("n"))


@query("""SELECT message FROM (SELECT unnest([CASE WHEN bad > 0 THEN 'labels outside 0 and 1' END, CASE WHEN rate < 0.001 OR rate > 0.5 THEN 'label rate out of range' END,
       CASE WHEN nulls > 0 THEN 'amounts missing' END, CASE WHEN inf > 0 THEN 'amounts infinite' END, CASE WHEN emails > 0 THEN 'e-mail domains missing' END]) AS message
       FROM (SELECT count(*) FILTER (WHERE is_fraud NOT IN (0, 1)) AS bad, avg(is_fraud) AS rate, count(*) - count(amount) AS nulls, count(*) FILTER (WHERE isinf(amount)) AS inf, count(*) - count(p_email) AS emails FROM txn)) WHERE message IS NOT NULL""")  # fmt: skip
def dataset_validation(spark, sf_dir):
    missing = lambda c: F.count("*") > F.count(c)
    rate = F.avg("is_fraud")
    tests = {"labels outside 0 and 1": F.count_if(~F.col("is_fraud").isin(0, 1)) > 0, "label rate out of range": (rate < 0.001) | (rate > 0.5), "amounts missing": missing("amount"), "amounts infinite": F.count_if(F.abs("amount") == float("inf")) > 0, "e-mail domains missing": missing("p_email")}
    one = transactions(spark, sf_dir).agg(F.array_compact(F.array(*[F.when(holds, text) for text, holds in tests.items()])).alias("m"))
    return one.select(F.explode("m").alias("message"))


# ---- alerts and windows ----


_DEDUP = "RECURSIVE " + sql.ALERTS + """, nth AS (SELECT user_id, severity, ts, transaction_id, row_number() OVER (PARTITION BY user_id, severity ORDER BY ts, transaction_id) AS n FROM alerts),
told AS (SELECT user_id, severity, n, transaction_id, ts AS last, true AS kept FROM nth WHERE n = 1
  UNION ALL SELECT nth.user_id, nth.severity, nth.n, nth.transaction_id, CASE WHEN nth.ts - last > INTERVAL 1 HOUR THEN nth.ts ELSE last END, nth.ts - last > INTERVAL 1 HOUR
  FROM told JOIN nth ON nth.user_id = told.user_id AND nth.severity = told.severity AND nth.n = told.n + 1)"""


@query("SELECT transaction_id FROM told WHERE kept", _DEDUP)
def alert_dedup(spark, sf_dir):
    """An alert is told if the user's last told one of its severity is more than an hour old."""
    return al.told(alerts(spark, sf_dir)).select("transaction_id")


@query("SELECT transaction_id, row_number() OVER (PARTITION BY severity, CAST(ts AS DATE) ORDER BY ts, transaction_id) AS position FROM alerts", sql.ALERTS)
def queue_position(spark, sf_dir):
    queued = alerts(spark, sf_dir).select("transaction_id", "ts", "severity", F.to_date("ts").alias("day"))
    return running_sum(queued, ["severity", "day"], F.lit(1), "position").select("transaction_id", F.col("position").cast("long"))


@query("""SELECT user_id, count(transaction_id) AS pending, round(max(fraud_score), 6) AS max_score FROM (SELECT DISTINCT user_id FROM txn)
       LEFT JOIN (SELECT * FROM alerts WHERE severity <> 'LOW') USING (user_id) GROUP BY 1""", sql.ALERTS)  # fmt: skip
def user_alert_summary(spark, sf_dir):
    pending = alerts(spark, sf_dir).filter("severity <> 'LOW'").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.max("fraud_score")).alias("max_score"))
    users = transactions(spark, sf_dir).select("user_id").distinct()
    return users.join(pending, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("pending"), "max_score")


@query("SELECT transaction_id FROM txn WHERE user_id NOT IN (SELECT user_id FROM alerts WHERE severity = 'CRITICAL')", sql.ALERTS)
def block_list_membership(spark, sf_dir):
    blocked = alerts(spark, sf_dir).filter("severity = 'CRITICAL'").select("user_id").distinct()
    return transactions(spark, sf_dir).join(blocked, "user_id", "left_anti").select("transaction_id")


@query("SELECT transaction_id FROM txn WHERE ts >= (SELECT max(ts) FROM txn) - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    t = transactions(spark, sf_dir)
    return t.crossJoin(F.broadcast(t.agg(F.max("ts").alias("as_of")))).filter(F.col("ts") >= F.col("as_of") - F.expr("interval 7 days")).select("transaction_id")  # one row


# ---- feedback ----


@query("""SELECT transaction_id, i FROM fb WHERE round(confidence, 6) >= 0.7 AND round(accuracy, 6) >= 0.6 AND minutes >= 2
       AND NOT (round(confidence, 6) > 0.9 AND ((label = 'fraud' AND prediction < 0.1) OR (label = 'legitimate' AND prediction > 0.9)))""", FEEDBACK)  # fmt: skip
def feedback_quality_filter(spark, sf_dir):
    return feedback.usable(given(spark, sf_dir)).select("transaction_id", "i")


@query("""SELECT transaction_id, count(*) AS n FROM fb, (SELECT max(ts) AS t FROM txn) GROUP BY 1
       HAVING (count(*) >= 2 OR max(given) <= any_value(t) - INTERVAL 1 HOUR) AND min(given) >= any_value(t) - INTERVAL 72 HOUR""", FEEDBACK)  # fmt: skip
def feedback_eligibility(spark, sf_dir):
    as_of = transactions(spark, sf_dir).agg(F.max("ts").alias("as_of"))
    return feedback.eligible(given(spark, sf_dir), as_of).select("transaction_id", "n")


_CONSENSUS = FEEDBACK + """, agreed AS (SELECT transaction_id, label, c AS consensus FROM (SELECT transaction_id, label, round(round(w, 6) / sum(w) OVER (PARTITION BY transaction_id), 5) AS c,
       row_number() OVER (PARTITION BY transaction_id ORDER BY round(w, 6) DESC, label) AS nth FROM (SELECT transaction_id, label, sum(confidence * accuracy * 0.9::DOUBLE) AS w FROM fb GROUP BY 1, 2)) WHERE nth = 1 AND c >= 0.8)"""


@query("SELECT * FROM agreed", _CONSENSUS)
def weighted_vote_consensus(spark, sf_dir):
    return feedback.consensus(given(spark, sf_dir))


@query("SELECT count(*) AS n, round(avg(consensus), 4) AS mean, count(*) FILTER (WHERE consensus >= 0.95) AS clear FROM agreed", _CONSENSUS)
def feedback_statistics(spark, sf_dir):
    return feedback.consensus(given(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.avg("consensus"), 4).alias("mean"), F.count_if(F.col("consensus") >= 0.95).alias("clear"))


# ---- evaluation ----


@query("""SELECT round(sum(p / ap::DOUBLE * hit / said), 6) AS ap FROM (SELECT p, sum(p) OVER () AS ap, sum(p) OVER (ORDER BY s DESC) AS hit, sum(n) OVER (ORDER BY s DESC) AS said
       FROM (SELECT fraud_score AS s, count(*) AS n, sum(is_fraud) AS p FROM scored GROUP BY 1))""", sql.SCORED)  # fmt: skip
def average_precision(spark, sf_dir):
    return evaluation.average_precision(scored(spark, sf_dir), "fraud_score", "is_fraud").select(r6("ap").alias("ap"))


@query("""SELECT round(coalesce(max(hit / ap::DOUBLE) FILTER (WHERE (said - hit) / (an - ap)::DOUBLE <= 0.01), 0), 6) AS recall FROM (SELECT sum(p) OVER () AS ap, sum(n) OVER () AS an, sum(p) OVER (ORDER BY s DESC) AS hit,
       sum(n) OVER (ORDER BY s DESC) AS said FROM (SELECT fraud_score AS s, count(*) AS n, sum(is_fraud) AS p FROM scored GROUP BY 1))""", sql.SCORED)  # fmt: skip
def recall_at_fpr(spark, sf_dir):
    return evaluation.recall_at_fpr(scored(spark, sf_dir), "fraud_score", "is_fraud").select(r6("recall").alias("recall"))


@query("""SELECT round(sum(n * abs(s - p)) / sum(n), 6) AS error FROM (SELECT count(*) AS n, avg(fraud_score) AS s, avg(is_fraud) AS p FROM scored GROUP BY least(floor(round(fraud_score, 6) * 10), 9))""", sql.SCORED)
def calibration_error(spark, sf_dir):
    return evaluation.calibration_error(scored(spark, sf_dir), "fraud_score", "is_fraud").select(r6("error").alias("error"))


@query("""SELECT round(max(d), 6) AS max_difference, round(avg(d), 6) AS mean_difference, round(stddev_pop(d), 6) AS std_difference, round(corr(fraud_score, ml_prediction), 6) AS correlation,
       round(avg(CAST(a = b AS INT)), 6) AS agreement, count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE b AND NOT a) AS only_second
       FROM (SELECT *, abs(fraud_score - ml_prediction) AS d, round(fraud_score, 6) >= 0.5 AS a, round(ml_prediction, 6) >= 0.5 AS b FROM scored)""", sql.SCORED)  # fmt: skip
def prediction_set_comparison(spark, sf_dir):
    one = evaluation.comparison(scored(spark, sf_dir), "fraud_score", "ml_prediction")
    return one.select(*[c if c.startswith("only") else r6(c).alias(c) for c in one.columns])


@query("SELECT transaction_id, round(0.5::DOUBLE * fraud_score + 0.3::DOUBLE * ml_prediction, 6) AS score FROM scored", sql.SCORED)
def weighted_ensemble_score(spark, sf_dir):
    part = lambda w, c: w * F.coalesce(c, F.lit(0.0))
    return scored(spark, sf_dir).select("transaction_id", r6(part(0.5, F.col("fraud_score")) + part(0.3, F.col("ml_prediction")) + part(0.2, F.lit(None).cast("double"))).alias("score"))


@query("""SELECT transaction_id, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY is_fraud)) AS in_training FROM txn""")
def stratified_split(spark, sf_dir):
    return evaluation.stratified_split(transactions(spark, sf_dir), "transaction_id", "is_fraud").select("transaction_id", "in_training")


@query("""SELECT round(sum(n / t::DOUBLE * ln(n * t / (f * y)::DOUBLE)), 6) AS mi FROM (SELECT n, sum(n) OVER (PARTITION BY product) AS f, sum(n) OVER (PARTITION BY is_fraud) AS y, sum(n) OVER () AS t
       FROM (SELECT product, is_fraud, count(*) AS n FROM txn GROUP BY 1, 2))""")  # fmt: skip
def mutual_information(spark, sf_dir):
    return evaluation.mutual_information(transactions(spark, sf_dir), "product", "is_fraud").select(r6("mi").alias("mi"))


# ---- drift and experiments ----


@query("""SELECT round(sum((o - e) * (o - e) / e), 4) AS statistic FROM (SELECT n AS o, sum(n) OVER (PARTITION BY product) * sum(n) OVER (PARTITION BY ref) / sum(n) OVER ()::DOUBLE AS e
       FROM (SELECT product, ref, count(*) AS n FROM sides GROUP BY 1, 2))""", _SIDES)  # fmt: skip
def chi_square(spark, sf_dir):
    # a cell without rows adds its expectation: both sides come in one row by product
    both = sides(spark, sf_dir).groupBy("product").agg(F.count_if("is_reference").alias("r"), F.count_if(~F.col("is_reference")).alias("c"))
    every = Window.partitionBy(F.lit(0))
    n, share = F.col("r") + F.col("c"), F.sum("r").over(every) / F.sum(F.col("r") + F.col("c")).over(every)
    cells = both.select("r", "c", (n * share).alias("er"), (n * (1 - share)).alias("ec"))
    term = lambda o, e: (F.col(o) - F.col(e)) * (F.col(o) - F.col(e)) / F.col(e)
    return cells.agg(F.round(F.sum(term("r", "er") + term("c", "ec")), 4).alias("statistic"))


@query("""SELECT 'psi' AS test, v AS value, CASE WHEN v >= 0.5 THEN 'critical' WHEN v >= 0.25 THEN 'high' WHEN v >= 0.1 THEN 'medium' ELSE 'low' END AS severity, v > 0.25 AS retrain FROM (SELECT round(sum((c - r) * ln(c / r)), 6) AS v FROM (SELECT greatest(coalesce(bins.r, 0) / nr, 1e-8) AS r, greatest(coalesce(bins.c, 0) / nc, 1e-8) AS c FROM grid LEFT JOIN bins USING (b), tot))
       UNION ALL SELECT 'concept', v, CASE WHEN v >= 0.4 THEN 'critical' WHEN v >= 0.2 THEN 'high' WHEN v >= 0.1 THEN 'medium' ELSE 'low' END, v > 0.02
       FROM (SELECT round(abs(sum((1 - ref) * is_fraud) / sum(1 - ref)::DOUBLE - sum(ref * is_fraud) / sum(ref)::DOUBLE), 6) AS v FROM sides)""", _PSI)  # fmt: skip
def drift_alert_table(spark, sf_dir):
    def judged(test: str, value: DataFrame, limits: tuple[float, ...], retrain: float) -> DataFrame:
        v, (a, b, c) = F.col("value"), limits
        level = F.when(v >= c, "critical").when(v >= b, "high").when(v >= a, "medium").otherwise("low")
        return value.select(F.lit(test).alias("test"), "value", level.alias("severity"), (v > retrain).alias("retrain"))

    both = sides(spark, sf_dir)
    psi = drift.psi_numeric(both, "amount").select(r6("psi").alias("value"))
    concept = drift.two_proportions(both, "is_fraud").select(r6(F.abs("difference")).alias("value"))
    return judged("psi", psi, (0.1, 0.25, 0.5), 0.25).unionByName(judged("concept", concept, (0.1, 0.2, 0.4), 0.02))


def bucket_sql(experiment: str) -> str:
    """user_id and b, the bucket that experiments.bucket gives, as a table."""
    powers = (1, 5536, 7296, 656, 1616, 6176, 336, 96)  # 65536 ** i modulo 10000
    total = " + ".join(f"('0x' || substr(m, {29 - 4 * i}, 4))::BIGINT * {p}" for i, p in enumerate(powers))
    return f"(SELECT user_id, CAST({total} AS BIGINT) % 10000 AS b FROM (SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR) || ':{experiment}') AS m FROM txn))"


_VARIANT = sql.SCORED + ", assigned AS (SELECT *, CASE WHEN b <= 5000 THEN 'control' ELSE 'treatment' END AS variant, round(fraud_score, 6) >= 0.3 AS said FROM scored JOIN " + bucket_sql("exp_1") + " USING (user_id))"


@query("""SELECT variant, count(*) AS predictions, count(*) FILTER (WHERE said AND is_fraud = 1) AS tp, count(*) FILTER (WHERE said AND is_fraud = 0) AS fp, count(*) FILTER (WHERE NOT said AND is_fraud = 1) AS fn,
       round(coalesce(sum(amount) FILTER (WHERE said AND is_fraud = 1), 0) - coalesce(sum(amount) FILTER (WHERE NOT said AND is_fraud = 1), 0) - 10 * count(*) FILTER (WHERE said AND is_fraud = 0), 4) AS business_value
       FROM assigned GROUP BY 1""", _VARIANT)  # fmt: skip
def variant_scorecard(spark, sf_dir):
    said, true = r6("fraud_score") >= 0.3, F.col("is_fraud") == 1
    variant = F.when(experiments.bucket(F.col("user_id"), "exp_1") <= 5000, "control").otherwise("treatment")
    worth = lambda holds: F.sum(F.when(holds, F.col("amount")).otherwise(0.0))
    value = worth(said & true) - worth(~said & true) - 10 * F.count_if(said & ~true)
    return scored(spark, sf_dir).groupBy(variant.alias("variant")).agg(
        F.count("*").alias("predictions"), F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.round(value, 4).alias("business_value"))
