"""Registered queries on records (CSV, JSON, tables by month, messages) and on models. Models have no SQL; tests hold their results against plain checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.operators import evaluation, models, profiles, rules, search
from cardlake.plans import sql
from cardlake.plans.decisions import training_batch
from cardlake.plans.queries import alerts, query, r6, scored
from cardlake.sources import records
from cardlake.sources.tables import read, transactions

FEATURES = ("amount", "amount_vs_avg", "amount_vs_last", "velocity", "hour", "weekday", "daily_count", "total_transactions", "addr1")
FLAGS = ("is_high_amount", "is_unusual_hour", "is_rapid", "amount_vs_avg")  # what the fallback score reads


# ---- records ----


@query("SELECT transaction_id, user_id, round(amount, 6) AS amount, product FROM txn")
def csv_scan(spark, sf_dir):
    kept = transactions(spark, sf_dir).select("transaction_id", "user_id", "amount", "product")
    path = records.scratch(spark, "csv")
    kept.write.csv(path, header=True)
    return records.csv(spark, path, kept.schema).withColumn("amount", r6("amount"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(amount), 4) AS amount FROM txn GROUP BY 1")
def partitioned_columnar_append(spark, sf_dir):
    path = records.scratch(spark, "by-month")
    records.append_by_month(transactions(spark, sf_dir).select("transaction_id", "user_id", "ts", "amount"), path)
    by = spark.read.schema("transaction_id long, user_id long, ts timestamp, amount double, month string").parquet(path).groupBy("month")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"))


@query("SELECT transaction_id, transaction_id % 50 = 0 AS is_bad, CASE WHEN transaction_id % 50 <> 0 THEN k END AS k FROM txn")
def bad_record_isolation(spark, sf_dir):
    """Every 50th JSON text is cut short first, so that there are bad ones."""
    broken = F.when(F.col("event_id") % 50 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = records.parsed(read(spark, sf_dir, "events").select(F.col("event_id").alias("transaction_id"), broken.alias("props")), "props", "k int")
    good, dead = records.split(rows)
    return good.select("transaction_id", "is_bad", "parsed.k").unionByName(dead.select("transaction_id", "is_bad", F.lit(None).cast("int").alias("k")))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, 'alert_' || transaction_id AS alert_id, severity, round(amount, 6) AS amount FROM alerts""", sql.ALERTS)
def alert_sink(spark, sf_dir):
    """Alerts as keyed JSON messages, written and read back."""
    path = records.scratch(spark, "alerts")
    records.alert_message(alerts(spark, sf_dir)).write.json(path)
    body = F.from_json("value", "alert_id string, severity string, transaction_details struct<amount: double>")
    return spark.read.json(path, schema="key string, value string").select("key", body.alias("v")).select("key", "v.alert_id", "v.severity", r6("v.transaction_details.amount").alias("amount"))


@query("""SELECT transaction_id, CAST(is_high_amount AS INT) + CAST(is_unusual_hour AS INT) + CAST(is_rapid AS INT) AS reasons, round(velocity, 6) AS velocity, round(fraud_score, 6) AS fraud_score FROM scored""", sql.SCORED)
def detection_results_append(spark, sf_dir):
    path = records.scratch(spark, "detections")
    records.detection_result(scored(spark, sf_dir), FEATURES).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    return stored.select("transaction_id", F.size("explanation").alias("reasons"), r6(F.col("features")["velocity"]).alias("velocity"), r6("scores.fraud_score").alias("fraud_score"))


_PROFILED, _NAMED = ("amount", "k", "addr1"), ("product", "p_email", "device")


@query("SELECT 'numeric' AS section, key, metric, round(value, 5) AS value FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS key, '{m}' AS metric, {f}({c})::DOUBLE AS value FROM txn" for c in _PROFILED for m, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("count", "count"))) + ") UNION ALL SELECT 'metadata', 'rows', 'count', count(*) FROM txn"
    + "".join(f" UNION ALL SELECT 'categorical', '{c}', 'missing', count(*) FILTER ({c} IS NULL) FROM txn UNION ALL SELECT 'categorical', '{c}:' || v, 'share', round(n / t::DOUBLE, 5) FROM (SELECT {c} AS v, count(*) AS n, (SELECT count(*) FROM txn) AS t FROM txn WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)" for c in _NAMED)
    + " UNION ALL SELECT 'time', CAST(hour(ts) AS VARCHAR), 'rate', round(avg(is_fraud), 5) FROM txn GROUP BY 2 UNION ALL SELECT 'time', CAST(hour(ts) AS VARCHAR), 'count', count(*) FROM txn GROUP BY 2")
def profile_report_sink(spark, sf_dir):
    """One nested JSON document of all sections, written, read again and laid out in rows."""
    path = records.scratch(spark, "profile")
    made = profiles.sections(transactions(spark, sf_dir), _PROFILED, _NAMED, "ts", "is_fraud")
    made.write.json(path)
    d = spark.read.schema(made.schema).json(path)
    row = lambda section, key, metric, value: F.struct(F.lit(section).alias("section"), key.alias("key"), metric.alias("metric"), F.round(value.cast("double"), 5).alias("value"))
    numeric = F.flatten(F.transform(F.map_entries("numeric"), lambda e: F.transform(F.map_entries(e["value"]), lambda m: row("numeric", e["key"], m["key"], m["value"]))))
    tops = F.flatten(F.transform(F.map_entries("categorical"), lambda e: F.transform(e["value"]["values"], lambda v: row("categorical", F.concat(e["key"], F.lit(":"), v["value"]), F.lit("share"), v["share"]))))
    missing = F.transform(F.map_entries("categorical"), lambda e: row("categorical", e["key"], F.lit("missing"), e["value"]["missing"]))
    hours = F.flatten(F.transform("time.by_hour", lambda h: F.array(row("time", h["hour"].cast("string"), F.lit("rate"), h["rate"]), row("time", h["hour"].cast("string"), F.lit("count"), h["n"]))))
    rows_ = F.array(row("metadata", F.lit("rows"), F.lit("count"), F.col("metadata.rows")))
    return d.select(F.inline(F.concat(numeric, tops, missing, hours, rows_)))


# ---- models ----


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, label and weight of every transaction; the rare label weighs as much as the other one in all."""
    found = transactions(spark, sf_dir).agg(F.try_divide(F.count_if(F.col("is_fraud") == 0), F.count_if(F.col("is_fraud") == 1))).first()[0]
    s = scored(spark, sf_dir).withColumns({"label": F.col("is_fraud").cast("double"), "weight": F.when(F.col("is_fraud") == 1, found or 1.0).otherwise(1.0)})
    aligned = models.aligned(s, FEATURES)
    return records.stored(aligned.select("transaction_id", "is_fraud", "product", "label", "weight", *FLAGS, *[f"f_{c}" for c in FEATURES]), "rows")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = records.stored(evaluation.stratified_split(rows(spark, sf_dir), "transaction_id", "is_fraud"), "split")
    return both.filter("in_training"), both.filter("not in_training")


@query()
def preprocessing_pipeline(spark, sf_dir):
    made = models.estimator(FEATURES, ("product",), models.logistic())
    r = rows(spark, sf_dir)
    out = type(made)(stages=made.getStages()[:2]).fit(r).transform(r)
    return out.select("transaction_id", models.vector_to_array("features").alias("features"), "label")


@query("""SELECT feature, round(mi, 6) AS mi FROM (SELECT feature, sum(n / t::DOUBLE * ln(n * t / (f * y)::DOUBLE)) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature, v) AS f, sum(n) OVER (PARTITION BY feature, is_fraud) AS y,
       sum(n) OVER (PARTITION BY feature) AS t FROM (SELECT feature, v, is_fraud, count(*) AS n FROM (SELECT 'product' AS feature, product AS v, is_fraud FROM txn UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), is_fraud FROM txn
       UNION ALL SELECT 'addr1', CAST(addr1 AS VARCHAR), is_fraud FROM txn) GROUP BY 1, 2, 3)) GROUP BY 1) ORDER BY mi DESC, feature LIMIT 2""")  # fmt: skip
def feature_selection(spark, sf_dir, top: int = 2):
    t = transactions(spark, sf_dir).select("is_fraud", "product", F.hour("ts").cast("string").alias("hour"), F.col("addr1").cast("string"))
    long = t.unpivot(["is_fraud"], ["product", "hour", "addr1"], "feature", "v")
    return evaluation.mutual_information_by(long, "feature", "v", "is_fraud").orderBy(F.desc("mi"), "feature").limit(top).withColumn("mi", r6("mi"))


@query()
def stratified_k_fold_auc(spark, sf_dir):
    r = models.folded(rows(spark, sf_dir), "transaction_id", "is_fraud").select("fold", "label", "weight", "product", *[f"f_{c}" for c in FEATURES])
    trials = models.validated(r, models.estimator(FEATURES, ("product",), models.logistic()), [{}])
    return spark.createDataFrame(trials, "auc double, deviation double")


@query()
def parameter_search(spark, sf_dir):
    """Eight draws of boosted trees, halved after each of three folds; small trees, so that the query ends soon (search.BOOSTED has the full ranges)."""
    space = search.BOOSTED | {"maxIter": search.Whole(2, 6, 2), "maxDepth": search.Whole(2, 4)}
    r = records.stored(models.folded(rows(spark, sf_dir), "transaction_id", "is_fraud", 3), "folds")
    table = search.new_table(spark, records.scratch(spark, "trials"))
    search.halving(table, space, 8, 3, 7, search.boosted_score(r, FEATURES, ("product",)))
    found = F.from_json("parameters", "maxDepth int, maxIter int, stepSize double, subsamplingRate double, featureShare double, minInstancesPerNode int").alias("p")
    return search.ranks(table.read(), 3).select("trial", found, "rungs", "score", "rank").select("trial", "p.*", "rungs", "score", "rank")


_RULES = ("is_high_amount", "is_unusual_hour", "is_rapid", "is_large")
_RULE_SPACE = {f: search.Uniform(0.0, 1.0) for f in _RULES} | {"limit": search.LogUniform(0.2, 2.0)}
_U = "('0x' || substr(md5('11:' || t || ':{n}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
_WEIGHTED = sql.SCORED + f""", params AS (SELECT t, {", ".join(f"{_U.format(n=n)} AS w_{n}" for n in _RULES)}, exp(ln(0.2::DOUBLE) + (ln(2.0::DOUBLE) - ln(0.2::DOUBLE)) * {_U.format(n="limit")}) AS lim FROM range(16) AS r(t)),
flagged AS (SELECT is_fraud, is_high_amount, is_unusual_hour, is_rapid, amount_vs_avg > 2 AS is_large, (row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id)) % 4 AS fold FROM scored),
cells AS (SELECT fold, is_high_amount, is_unusual_hour, is_rapid, is_large, count(*) AS n, sum(is_fraud) AS p FROM flagged GROUP BY ALL),
f1 AS (SELECT t, fold, 2 * coalesce(sum(p) FILTER (WHERE said), 0) / greatest(coalesce(sum(n) FILTER (WHERE said), 0) + sum(p), 1)::DOUBLE AS f FROM (
  SELECT *, round({" + ".join(f"w_{n} * CAST({n} AS INT)" for n in _RULES)}, 9) >= round(lim, 9) AS said FROM params, cells) GROUP BY 1, 2),
r0 AS (SELECT t FROM f1 WHERE fold = 0 QUALIFY row_number() OVER (ORDER BY f DESC, t) <= 8),
r1 AS (SELECT t FROM f1 JOIN r0 USING (t) WHERE fold <= 1 GROUP BY t QUALIFY row_number() OVER (ORDER BY (max(f) FILTER (fold = 0) + max(f) FILTER (fold = 1)) / 2 DESC, t) <= 4),
r2 AS (SELECT t FROM f1 JOIN r1 USING (t) WHERE fold <= 2 GROUP BY t QUALIFY row_number() OVER (ORDER BY (max(f) FILTER (fold = 0) + max(f) FILTER (fold = 1) + max(f) FILTER (fold = 2)) / 3 DESC, t) <= 2),
runs AS (SELECT t, 1 + CAST(t IN (FROM r0) AS INT) + CAST(t IN (FROM r1) AS INT) + CAST(t IN (FROM r2) AS INT) AS rungs FROM params),
means AS (SELECT t, any_value(rungs) AS rungs, avg(f) AS score FROM runs JOIN f1 USING (t) WHERE fold < rungs GROUP BY t)"""


@query("SELECT t::INT AS trial, rungs::BIGINT AS rungs, round(score, 6) AS score, round(lim, 6) AS lim, row_number() OVER (ORDER BY rungs DESC, score DESC, t)::INT AS rank FROM means JOIN params USING (t)", _WEIGHTED)
def rule_weight_search(spark, sf_dir):
    """Sixteen draws of rule weights and a limit, halved after each of four folds by their F1; a rung is one pass over the data, and a second run adds no trial."""
    s = scored(spark, sf_dir).withColumns({"is_large": F.col("amount_vs_avg") > 2, "label": F.col("is_fraud")})
    r = records.stored(models.folded(s.select("transaction_id", "is_fraud", "label", *_RULES), "transaction_id", "is_fraud", 4), "rules")
    table = search.new_table(spark, records.scratch(spark, "trials"))
    for _ in range(2):
        search.halving(table, _RULE_SPACE, 16, 4, 11, search.rules_score(r, _RULES), one_by_one=False)
    lim = F.from_json("parameters", "limit double")["limit"]
    return search.ranks(table.read(), 4).select("trial", "rungs", r6("score").alias("score"), r6(lim).alias("lim"), "rank")


@query()
def batch_scoring(spark, sf_dir):
    train, rest = _split(spark, sf_dir)
    model = models.estimator(FEATURES, ("product",), models.logistic()).fit(train)
    return models.score(rest, model, rules.fallback_score()).select("transaction_id", "score", "is_fraud")


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new scores of the held-out rows; the new model also has the agreed feedback, of double weight."""
    train, rest = _split(spark, sf_dir)
    pipeline = models.estimator(FEATURES, ("product",), models.logistic())
    agreed = training_batch(spark, sf_dir).select("transaction_id", F.col("label").cast("double").alias("label"))
    feedback = records.stored(train.drop("label", "weight").join(agreed, "transaction_id").withColumn("weight", F.lit(2.0)), "feedback")
    old = models.score(rest, pipeline.fit(train), rules.fallback_score(), "old").drop("i_product")
    return models.score(old, models.refit(pipeline, train, feedback), rules.fallback_score(), "new")


@query()
def weighted_update_from_feedback(spark, sf_dir):
    return updated(spark, sf_dir).select("transaction_id", "old", "new", "is_fraud")


@query()
def update_gate(spark, sf_dir):
    both = records.stored(updated(spark, sf_dir).select("old", "new", "is_fraud"), "scores")
    return models.gate(both, "old", "new", evaluation.auc(both, "new", "is_fraud"))


@query()
def shadow_comparison(spark, sf_dir):
    return evaluation.comparison(updated(spark, sf_dir), "old", "new")
