"""Registered queries on features as of an event, scoring by the deployed version, ramps of a new model, and the law of score differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators import evaluation, feedback, models, rollout, rules
from cardlake.operators import alerts as al
from cardlake.operators import features as ft
from cardlake.plans import sql
from cardlake.plans.decisions import _ACTION, responses
from cardlake.plans.learning import FEATURES, FLAGS, rows
from cardlake.plans.monitoring import _CONSENSUS, bucket_sql, given
from cardlake.plans.queries import DEPLOYED, deployments, query, r6, scored
from cardlake.plans.reports import _sql_p
from cardlake.sources import records
from cardlake.sources.tables import transactions
from cardlake.sources.versions import Table
from cardlake.streaming import jobs, live

# ---- features as of an event ----

_MAP = ("transactions", "amount", "largest", "last_amount", "frauds")


def snapshots(txn: DataFrame) -> DataFrame:
    """user_id, since, transaction_id and features, a map of what a user's transactions amount to from each of them on."""
    upto = ft.by_user().rowsBetween(Window.unboundedPreceding, 0)
    made = {"transactions": F.count("*").over(upto), "amount": F.sum("amount").over(upto), "largest": F.max("amount").over(upto), "last_amount": F.col("amount"), "frauds": F.sum("is_fraud").over(upto)}
    values = F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*[c.cast("double") for c in made.values()]))
    return txn.select("user_id", F.col("ts").alias("since"), "transaction_id", values.alias("features"))


@query("""SELECT transaction_id, CASE WHEN agreed.label = 'fraud' THEN 1 ELSE 0 END AS label, round(weight, 4) AS weight, coalesce(n, 0)::DOUBLE AS f_transactions, round(s, 4) AS f_amount, m AS f_largest, l AS f_last_amount, fr::DOUBLE AS f_frauds
       FROM agreed JOIN alerts USING (transaction_id) JOIN (SELECT transaction_id, least(1.0::DOUBLE, (consensus + least(0.2::DOUBLE, count(*) * 0.1::DOUBLE)) * avg(accuracy) * avg(confidence)) AS weight FROM fb JOIN agreed USING (transaction_id) GROUP BY transaction_id, consensus) USING (transaction_id),
       LATERAL (SELECT count(*) AS n, sum(amount) AS s, max(amount) AS m, arg_max(amount, (ts, transaction_id)) AS l, sum(is_fraud) AS fr FROM txn AS e WHERE e.user_id = alerts.user_id AND e.ts < alerts.ts) AS f""", _CONSENSUS)  # fmt: skip
def training_batch_with_features(spark, sf_dir):
    """Agreed labels with their weights and a map of features as they stood before the event: nothing of its own time or later has a part in it."""
    fb, txn = given(spark, sf_dir), transactions(spark, sf_dir)
    w = feedback.weights(fb, txn.agg(F.max("ts").alias("as_of"))).select("transaction_id", F.col("quality").alias("weight"))
    labels = feedback.consensus(fb).select("transaction_id", (F.col("label") == "fraud").cast("int").alias("label")).join(w, "transaction_id")
    events = fb.select("transaction_id", "user_id").distinct().join(txn.select("transaction_id", "ts"), "transaction_id").join(labels, "transaction_id")
    batch = ft.as_of(events, snapshots(txn), "since", "features", ("user_id",), "transaction_id", strict=True)
    value = lambda n: F.col("features")[n]
    return batch.select(
        "transaction_id", "label", F.round("weight", 4).alias("weight"), F.coalesce(value("transactions"), F.lit(0.0)).alias("f_transactions"), F.round(value("amount"), 4).alias("f_amount"),
        value("largest").alias("f_largest"), value("last_amount").alias("f_last_amount"), value("frauds").alias("f_frauds"),
    )


# ---- scoring by the deployed version ----

_ACTIVE = [(v, since) for v, since in DEPLOYED]
_UNTIL = [*[s for _, s in DEPLOYED[1:]], "9999-01-01"]
_MODELS = ("v1.0", "v1.1")  # the versions of the log that have a model
_VERSIONED = sql.SCORED + ", dep(v, a, b) AS (VALUES " + ", ".join(f"('{v}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for (v, a), b in zip(_ACTIVE, _UNTIL, strict=True)) + ")"


@query(f"""SELECT transaction_id, v AS version, v NOT IN {_MODELS} AS is_fallback, CASE WHEN v NOT IN {_MODELS} THEN round(least(CASE WHEN is_high_amount THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_rapid THEN 0.2::DOUBLE ELSE 0 END
       + CASE WHEN is_unusual_hour THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN amount_vs_avg > 5 THEN 0.4::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) END AS fallback, true AS in_range FROM scored JOIN dep ON ts >= a AND ts < b""", _VERSIONED)  # fmt: skip
def stream_scoring_by_version(spark, sf_dir):
    """A stream scored by the model that was deployed at each row's time, two models in one run, and by rules where the active version has none."""
    r = rows(spark, sf_dir)
    folder = records.scratch(spark, "models")
    for i, version in enumerate(_MODELS):
        models.estimator(FEATURES, ("product",), models.logistic()).fit(r.filter(F.col("transaction_id") % 2 == i)).write().save(f"{folder}/{version}")
    log = Table(spark, records.scratch(spark, "deployments"), jobs.DEPLOYMENTS)
    path = F.when(F.col("version").isin(*_MODELS), F.concat(F.lit(f"{folder}/"), "version"))
    log.append(deployments(spark).withColumn("path", path))
    stored = records.scratch(spark, "to-score")
    wanted = r.join(transactions(spark, sf_dir).select("transaction_id", "ts"), "transaction_id").select("transaction_id", "ts", "product", *FLAGS, *[f"f_{c}" for c in FEATURES])
    wanted.repartition(2, "transaction_id").write.parquet(stored)
    out = records.scratch(spark, "stream-scores")
    jobs.run(live.files(spark, stored, wanted.schema, per_trigger=1), jobs.scored_by_version(log, f"{out}/rows", rules.fallback_score()), f"{out}/checkpoint")
    found, fallback = jobs.read_batches(spark, f"{out}/rows", jobs.SCORES), ~F.col("is_model")
    return found.select("transaction_id", "version", fallback.alias("is_fallback"), F.when(fallback, r6("score")).alias("fallback"), F.col("score").between(0, 1).alias("in_range"))


# ---- the ramp of a new model ----

_PERIODS = ("2024-01-08", "2024-01-15", "2024-01-22")
_RAMP = sql.SCORED + f""", placed AS (SELECT transaction_id, fraud_score, ml_prediction, b, CASE {" ".join(f"WHEN ts < TIMESTAMP '{d}' THEN {i}" for i, d in enumerate(_PERIODS))} ELSE 3 END AS period FROM scored JOIN {bucket_sql('ramp_1')} USING (user_id)),
gates AS (SELECT period, count(*) >= 100 AND avg(CAST((round(fraud_score, 6) >= 0.5) = (round(ml_prediction, 6) >= 0.5) AS INT)) >= 0.9 AND avg(abs(fraud_score - ml_prediction)) <= {{limit}} AS ok FROM placed GROUP BY 1),
shares AS (SELECT period, CASE WHEN count(*) FILTER (WHERE NOT ok) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 0.0::DOUBLE WHEN period = 0 THEN 0.05::DOUBLE WHEN period = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS share FROM gates)"""
_RAMP_SQL = "SELECT period AS stage, count(*) AS n, any_value(share) AS share, count(*) FILTER (WHERE b <= round(share * 10000) AND share > 0) AS n_new, round(sum(CASE WHEN b <= round(share * 10000) AND share > 0 THEN ml_prediction ELSE fraud_score END), 4) AS score FROM placed JOIN shares USING (period) GROUP BY 1"


def ramp(spark: SparkSession, sf_dir: str, limit: float) -> DataFrame:
    """Four weeks, a stage each: rows served by either model and the sum of what was served."""
    s = records.stored(scored(spark, sf_dir).select("transaction_id", "user_id", "ts", "fraud_score", "ml_prediction"), "ramp")
    table, bounds = Table(spark, records.scratch(spark, "stages"), rollout.STAGES), (None, *_PERIODS, None)
    logs = Table(spark, records.scratch(spark, "ramp-log"), "stage int, share double, is_new boolean, score double")
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        week = s.filter((F.lit(True) if a is None else F.col("ts") >= a) & (F.lit(True) if b is None else F.col("ts") < b))
        log = rollout.stage(table, week, "user_id", "ramp_1", "fraud_score", "ml_prediction", most_difference=limit)
        logs.append(log.withColumn("stage", F.lit(i)), i)
    return logs.read().groupBy("stage").agg(F.count("*").alias("n"), F.first("share").alias("share"), F.count_if("is_new").alias("n_new"), F.round(F.sum("score"), 4).alias("score"))


@query(_RAMP_SQL, _RAMP.format(limit=0.5))
def shadow_ramp(spark, sf_dir):
    return ramp(spark, sf_dir, 0.5)


@query(_RAMP_SQL, _RAMP.format(limit=0.0001))
def shadow_ramp_rolled_back(spark, sf_dir):
    """The same with a gate that the first stage fails: from then on the old model serves all."""
    return ramp(spark, sf_dir, 0.0001)


# ---- score differences ----


@query(f"""SELECT count(*) AS n, round(d, 5) AS d, round(CASE WHEN d * d * count(*) < 0.04 THEN 1.0::DOUBLE ELSE greatest(least(2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0::DOUBLE * i * i * d * d * count(*)))), 1.0::DOUBLE), 0.0::DOUBLE) END, 4) AS p
       FROM z, (SELECT max(greatest(i / n::DOUBLE - law, law - (i - 1) / n::DOUBLE)) AS d FROM (SELECT row_number() OVER (ORDER BY z) AS i, count(*) OVER () AS n, CASE WHEN z > 0 THEN 1 - {_sql_p("z")} / 2 ELSE {_sql_p("z")} / 2 END AS law FROM z)) AS e GROUP BY d""",
       sql.SCORED + ", z AS (SELECT (dif - avg(dif) OVER ()) / stddev_samp(dif) OVER () AS z FROM (SELECT fraud_score - ml_prediction + (amount % 1) / 10 AS dif FROM scored))")
def normality_of_differences(spark, sf_dir):
    """The one-sample Kolmogorov-Smirnov test of standardised score differences (spread by the amount's cents, as scores have few values) against a normal law."""
    d = F.col("fraud_score") - F.col("ml_prediction") + (F.col("amount") % 1) / 10
    s = records.stored(scored(spark, sf_dir).select(d.alias("d")), "differences")
    one = s.agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    found = evaluation.normal_distance(s.crossJoin(F.broadcast(one)), (F.col("d") - F.col("m")) / F.col("s"))  # one row
    return found.select("n", F.round("d", 5).alias("d"), F.round("p", 4).alias("p"))


# ---- queues of actions ----

_QUEUES = ", det(action, queue, name, receiver, status, hours) AS (VALUES " + ", ".join(f"('{a}', '{q}', '{n}', '{t}', '{st}', {h or 'NULL'})" for a, (q, n, t, st, _, h) in al.DETAILS.items()) + ")"


@query("""SELECT queue, name || '_' || transaction_id AS item, user_id, row_number() OVER (PARTITION BY queue ORDER BY ts, transaction_id) AS position, receiver, status, ts + to_hours(hours::INT) AS expires_at, round(fraud_score, 5) AS fraud_score FROM acted JOIN det USING (action)""", _ACTION + _QUEUES)
def action_queues(spark, sf_dir):
    """Every action's detail rows in a table of its own, appended as one version each and read again."""
    made = records.stored(al.details(al.routed(responses(spark, sf_dir))), "details")
    parts, path = [], records.scratch(spark, "queues")
    for queue, *_ in al.DETAILS.values():
        table = Table(spark, f"{path}/{queue}", made.schema)
        table.append(made.filter(F.col("queue") == queue), 0)
        parts.append(table.read())
    d = lambda c: F.col(f"detail.{c}")
    return reduce(DataFrame.unionByName, parts).select("queue", "item", "user_id", "position", d("to").alias("receiver"), d("status").alias("status"), d("expires_at").cast("timestamp_ntz").alias("expires_at"), F.round(d("fraud_score"), 5).alias("fraud_score"))


@query("""SELECT transaction_id, CAST(user_id AS VARCHAR) AS key, round(fraud_score, 5) AS fraud_score, fraud_score >= 0.3 AND round(fraud_score, 6) >= 0.3 AS is_alert, concat_ws(',', CASE WHEN is_high_amount THEN 'is_high_amount' END, CASE WHEN is_unusual_hour THEN 'is_unusual_hour' END, CASE WHEN is_rapid THEN 'is_rapid' END) AS reasons,
       round(amount_vs_avg, 4) AS amount_vs_avg, product, 'rules-1' AS model FROM scored""", sql.SCORED)  # fmt: skip
def detection_result_sink(spark, sf_dir):
    """Detection results as keyed messages with transaction, decision, explanation, features and metadata, through a stream to a table, decoded again."""
    s = scored(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    names = ("amount_vs_avg", "velocity", "gap_seconds")
    flags = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("is_high_amount", "is_unusual_hour", "is_rapid")]))
    body = [
        F.struct("transaction_id", "user_id", "ts", "amount", "product").alias("transaction"), F.struct("fraud_score", (r6("fraud_score") >= 0.3).alias("is_alert")).alias("decision"), flags.alias("explanation"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names])).alias("features"), F.struct(F.lit("rules-1").alias("model")).alias("metadata"),
    ]
    path = records.scratch(spark, "results")
    s.select(F.lit("results").alias("topic"), *records.message("user_id", *body)).write.json(path)
    out = records.scratch(spark, "result-sink")
    jobs.run(jobs.messages(spark, path, 4), lambda b, n: jobs.write_batch(b, f"{out}/rows", n), f"{out}/checkpoint")
    kind = "transaction struct<transaction_id: bigint, product: string>, decision struct<fraud_score: double, is_alert: boolean>, explanation array<string>, features map<string, double>, metadata struct<model: string>"
    v = jobs.read_batches(spark, f"{out}/rows", jobs.MESSAGE).select("key", F.from_json("value", kind).alias("v"))
    return v.select("v.transaction.transaction_id", "key", F.round("v.decision.fraud_score", 5).alias("fraud_score"), "v.decision.is_alert", F.array_join("v.explanation", ",").alias("reasons"), F.round(F.col("v.features")["amount_vs_avg"], 4).alias("amount_vs_avg"), "v.transaction.product", "v.metadata.model")
