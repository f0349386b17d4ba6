"""Registered queries on rule adjustments, responses, joins of predictions with what follows them, and metric histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators import alerts as al
from cardlake.operators import evaluation, experiments, feedback, metrics, rules
from cardlake.operators import features as ft
from cardlake.plans import sql
from cardlake.plans.monitoring import _CONSENSUS, _VARIANT, FEEDBACK, given, sides, variant_scorecard
from cardlake.plans.queries import _HISTORY, _SIDES, ORACLE, alerts, profiled, query, r6, scored
from cardlake.sources.tables import transactions

# ---- scores and rules ----


@query("""SELECT transaction_id, round(s4, 6) AS adjusted, CAST(h1 AS INT) + CAST(h2 AS INT) + CAST(h3 AS INT) + CAST(h4 AS INT) AS n_applied, round(s4 - fraud_score, 6) AS delta FROM (
       SELECT *, CASE WHEN h4 THEN least(s3 + 0.1::DOUBLE, 1.0::DOUBLE) ELSE s3 END AS s4 FROM (SELECT *, CASE WHEN h3 THEN least(s2 + 0.2::DOUBLE, 1.0::DOUBLE) ELSE s2 END AS s3 FROM (
       SELECT *, CASE WHEN h2 THEN least(s1 + 0.3::DOUBLE, 1.0::DOUBLE) ELSE s1 END AS s2 FROM (SELECT *, CASE WHEN h1 THEN greatest(fraud_score, 0.8::DOUBLE) ELSE fraud_score END AS s1 FROM (
       SELECT *, amount > 300 AS h1, total_transactions > 0 AND gap_seconds < 3600 AS h2, is_unusual_hour AS h3, amount >= 100 AND amount - floor(amount) < 0.1 AS h4 FROM scored)))))""", sql.SCORED)  # fmt: skip
def sequential_rule_adjustment(spark, sf_dir):
    a = F.col("amount")
    up = lambda by: lambda s: F.least(s + by, F.lit(1.0))
    listed = (
        rules.Adjustment("large", a > 300, lambda s: F.greatest(s, F.lit(0.8))),
        rules.Adjustment("rapid", (F.col("total_transactions") > 0) & (F.col("gap_seconds") < 3600), up(0.3)),
        rules.Adjustment("unusual_hour", F.col("is_unusual_hour"), up(0.2)),
        rules.Adjustment("round", (a >= 100) & (a - F.floor(a) < 0.1), up(0.1)),
    )
    out = rules.adjusted(scored(spark, sf_dir), "fraud_score", listed)
    return out.select("transaction_id", r6("adjusted").alias("adjusted"), F.size("applied").alias("n_applied"), r6(F.col("adjusted") - F.col("fraud_score")).alias("delta"))


@query("""SELECT transaction_id, round(least(CASE WHEN is_high_amount THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN is_rapid THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN is_unusual_hour THEN 0.1::DOUBLE ELSE 0 END
       + CASE WHEN amount_vs_avg > 5 THEN 0.4::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS score FROM feat""", sql.PROFILE)  # fmt: skip
def fallback_score(spark, sf_dir):
    return profiled(spark, sf_dir).select("transaction_id", r6(rules.fallback_score()).alias("score"))


@query("SELECT transaction_id, round(least(1.0::DOUBLE, 2 * abs(fraud_score - 0.5::DOUBLE)), 6) AS confidence FROM scored", sql.SCORED)
def confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", r6(rules.confidence(F.col("fraud_score"))).alias("confidence"))


@query("""SELECT transaction_id, coalesce(array_to_string(list_sort(list_filter(CASE WHEN round(fraud_score, 6) >= 0.9 THEN ['block_transaction', 'freeze_account', 'immediate_investigation']
       WHEN round(fraud_score, 6) >= 0.7 THEN ['require_additional_authentication', 'flag_for_review'] WHEN round(fraud_score, 6) >= 0.5 THEN ['enhanced_monitoring', 'risk_assessment'] ELSE [] END
       || [CASE WHEN is_high_amount THEN 'amount_verification' END, CASE WHEN is_unusual_hour THEN 'time_verification' END], lambda x: x IS NOT NULL)), ','), '') AS actions FROM alerts""", sql.ALERTS)  # fmt: skip
def recommended_actions(spark, sf_dir):
    return alerts(spark, sf_dir).select("transaction_id", F.array_join(rules.recommended_actions(F.round("fraud_score", 6)), ",").alias("actions"))


@query("""SELECT transaction_id, is_new_device, has_email, is_free_email, sum(CAST(is_new_device AS INT)) OVER (PARTITION BY user_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING)::BIGINT AS devices FROM (
       SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY ts, transaction_id) = 1 AS is_new_device, p_email IS NOT NULL AS has_email, coalesce(p_email IN ('gmail', 'yahoo', 'hotmail'), false) AS is_free_email FROM txn)""")  # fmt: skip
def device_channel_flags(spark, sf_dir):
    t = transactions(spark, sf_dir).withColumn("new", ft.first_seen("user_id", "device"))
    so_far = F.sum("new").over(ft.by_user().rowsBetween(Window.unboundedPreceding, 0))
    free = F.coalesce(F.col("p_email").isin("gmail", "yahoo", "hotmail"), F.lit(False))
    return t.select("transaction_id", (F.col("new") == 1).alias("is_new_device"), F.col("p_email").isNotNull().alias("has_email"), free.alias("is_free_email"), so_far.alias("devices"))


@query("""SELECT transaction_id, total_transactions = 0 AS is_first, amount < 10 AS is_small, amount = floor(amount) AS is_round, daily_count > 2 AS is_busy_day,
       round(CASE WHEN max_amount_before > 0 THEN amount / max_amount_before ELSE 1.0 END, 6) AS amount_vs_max,
       round(total_transactions / greatest(date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)), 1)::DOUBLE, 6) AS per_account_day FROM feat""", sql.PROFILE)  # fmt: skip
def behaviour_flags(spark, sf_dir):
    a, n = F.col("amount"), F.col("total_transactions")
    opened = F.min("ts").over(ft.by_user().rowsBetween(Window.unboundedPreceding, 0))
    days = F.greatest(F.date_diff(F.to_date("ts"), F.to_date("opened")), F.lit(1))
    return profiled(spark, sf_dir).withColumn("opened", opened).select(
        "transaction_id", (n == 0).alias("is_first"), (a < 10).alias("is_small"), (a == F.floor(a)).alias("is_round"), (F.col("daily_count") > 2).alias("is_busy_day"),
        r6(ft.ratio(a, F.col("max_amount_before"))).alias("amount_vs_max"), r6(n / days).alias("per_account_day"))


@query("""SELECT transaction_id, round(CASE WHEN s > 0 THEN (amount - m) / s ELSE 0 END, 5) AS z, round(hour_rate, 6) AS hour_rate FROM (
       SELECT *, avg(amount) OVER b AS m, stddev_samp(amount) OVER b AS s FROM txn WINDOW b AS (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       JOIN (SELECT hour(ts) AS h, avg(is_fraud) AS hour_rate FROM txn GROUP BY 1) ON h = hour(ts)""")  # fmt: skip
def derived_scores(spark, sf_dir):
    t = transactions(spark, sf_dir).withColumn("h", F.hour("ts"))
    rates = t.groupBy("h").agg(F.avg("is_fraud").alias("rate"))
    mean, deviation = F.avg("amount").over(ft.before()), F.stddev_samp("amount").over(ft.before())
    z = F.when(deviation > 0, (F.col("amount") - mean) / deviation).otherwise(0.0)
    return t.withColumn("z", z).join(F.broadcast(rates), "h").select("transaction_id", F.round("z", 5).alias("z"), r6("rate").alias("hour_rate"))  # 24 rows


# ---- responses ----

_ACTION = _HISTORY + """, acted AS (SELECT *, CASE WHEN s >= 0.9 OR (s >= 0.7 AND rep) THEN 'immediate_block' WHEN s >= 0.8 AND alerts_24h >= 3 THEN 'auto_investigate' WHEN s >= 0.8 THEN 'manual_review'
       WHEN s >= 0.6 AND (risk_before = 'high' OR alerts_24h >= 2) THEN 'manual_review' WHEN s >= 0.6 THEN 'notify_team' WHEN rep OR alerts_24h >= 5 THEN 'escalate'
       WHEN s >= 0.3 THEN 'notify_team' ELSE 'log_only' END AS action FROM (SELECT *, round(fraud_score, 6) AS s, alerts_7d >= 3 AS rep FROM risk))"""  # fmt: skip


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.response(al.sticky_risk(al.history(alerts(spark, sf_dir))))


@query("""SELECT transaction_id, action, CASE action WHEN 'immediate_block' THEN ts + INTERVAL 1 DAY WHEN 'auto_investigate' THEN ts + INTERVAL 7 DAY WHEN 'manual_review' THEN ts + INTERVAL 3 DAY END AS expires_at,
       CASE WHEN action IN ('auto_investigate', 'escalate', 'immediate_block') THEN 'high' WHEN action IN ('manual_review', 'notify_team') THEN 'medium' ELSE 'low' END AS priority, action = 'immediate_block' AS blocks FROM acted""", _ACTION)  # fmt: skip
def action_routing(spark, sf_dir):
    routed = al.routed(responses(spark, sf_dir))
    return routed.select("transaction_id", "action", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "priority", "blocks")


@query("""SELECT transaction_id, 'Fraud alert: user ' || user_id AS subject, severity || ' alert of transaction ' || transaction_id || ', action ' || action AS message,
       CASE WHEN action IN ('auto_investigate', 'escalate', 'immediate_block') THEN 'high' ELSE 'medium' END AS priority FROM acted WHERE action <> 'log_only'""", _ACTION)  # fmt: skip
def notification_log(spark, sf_dir):
    return al.notifications(al.routed(responses(spark, sf_dir))).select("transaction_id", "subject", "message", "priority")


@query("""SELECT severity, count(*) AS n, count(*) FILTER (WHERE amount / 10.0::DOUBLE <= l) AS in_time FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 30 ELSE 300 END AS l FROM alerts) GROUP BY 1""", sql.ALERTS)
def sla_check(spark, sf_dir):
    """A tenth of the amount stands for seconds."""
    in_time = F.col("amount") / 10 <= al.seconds_allowed(F.col("severity"))
    return alerts(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.count_if(in_time).alias("in_time"))


@query("""SELECT transaction_id, CASE WHEN resolved IS NOT NULL THEN CASE WHEN verdict = 'fraud' THEN 'RESOLVED' ELSE 'FALSE_POSITIVE' END ELSE 'INVESTIGATING' END AS status, ts AS pending_at, started AS investigating_at, resolved AS resolved_at
       FROM (SELECT transaction_id, any_value(ts) AS ts, min(given) AS started, max(given) FILTER (WHERE i > 0) AS resolved, max_by(label, i) AS verdict
       FROM (SELECT fb.*, alerts.ts FROM fb JOIN alerts USING (transaction_id)) GROUP BY 1)""", FEEDBACK)  # fmt: skip
def alert_status_update(spark, sf_dir):
    """The first feedback starts an investigation, a later one ends it."""
    pending = alerts(spark, sf_dir).select("transaction_id", F.lit("PENDING").alias("status"), F.col("ts").alias("at"))
    ended = F.when(F.col("i") == 0, "INVESTIGATING").when(F.col("label") == "fraud", "RESOLVED").otherwise("FALSE_POSITIVE")
    log = pending.unionByName(given(spark, sf_dir).select("transaction_id", ended.alias("status"), F.col("given").alias("at")))
    now = al.status_of(log)
    return now.select("transaction_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("pending_at", "investigating_at", "resolved_at")])


# ---- joins ----


@query("SELECT transaction_id, product, amount, round(fraud_score, 6) AS fraud_score, severity FROM txn JOIN (SELECT transaction_id, fraud_score, severity FROM alerts) USING (transaction_id)", sql.ALERTS)
def inner_equi_join(spark, sf_dir):
    found = alerts(spark, sf_dir).select("transaction_id", r6("fraud_score").alias("fraud_score"), "severity")
    return transactions(spark, sf_dir).select("transaction_id", "product", "amount").join(found, "transaction_id")


@query("""SELECT transaction_id, count(p) AS n, round(coalesce(avg(s), 0), 6) AS mean, min(p) AS oldest FROM (SELECT a.transaction_id, b.transaction_id AS p, b.fraud_score AS s
       FROM alerts a LEFT JOIN (SELECT transaction_id, user_id, ts, fraud_score FROM alerts) b ON a.user_id = b.user_id AND (b.ts, b.transaction_id) < (a.ts, a.transaction_id) AND b.ts >= a.ts - INTERVAL 30 DAY
       QUALIFY row_number() OVER (PARTITION BY a.transaction_id ORDER BY b.ts DESC, b.transaction_id DESC) <= 50) GROUP BY 1""", sql.ALERTS)  # fmt: skip
def interval_self_join(spark, sf_dir):
    return al.prior(alerts(spark, sf_dir)).select(
        "transaction_id", F.size("prior").cast("long").alias("n"), r6(al.mean_of("prior", "fraud_score")).alias("mean"), F.array_min(F.transform("prior", lambda p: p["transaction_id"])).alias("oldest"))


@query("SELECT transaction_id, variant, round(fraud_score, 6) AS fraud_score FROM assigned", _VARIANT)
def assignment_join(spark, sf_dir):
    variant = F.when(experiments.bucket(F.col("user_id"), "exp_1") <= 5000, "control").otherwise("treatment")
    assigned = transactions(spark, sf_dir).select("user_id").distinct().select("user_id", variant.alias("variant"))
    return scored(spark, sf_dir).join(assigned, "user_id").select("transaction_id", "variant", r6("fraud_score").alias("fraud_score"))


@query("SELECT transaction_id, min_by(label, i) AS first_label, count(*) AS labels, max(i)::INT + 1 AS hours FROM fb GROUP BY 1", FEEDBACK)
def delayed_label_join(spark, sf_dir):
    found = alerts(spark, sf_dir).select("transaction_id", "ts")
    late = (F.unix_micros("given") - F.unix_micros("ts")) / 3.6e9
    near = found.join(given(spark, sf_dir).select("transaction_id", "label", "given"), "transaction_id").withColumn("late", late).filter(F.col("late").between(0, 72))
    return near.groupBy("transaction_id").agg(F.min_by("label", "given").alias("first_label"), F.count("*").alias("labels"), F.round(F.max("late")).cast("int").alias("hours"))


@query("""SELECT product, round(greatest(coalesce(r, 0), 1e-8), 6) AS reference, round(greatest(coalesce(c, 0), 1e-8), 6) AS current FROM (SELECT product, count(*) / (SELECT count(*) FROM sides WHERE ref = 1)::DOUBLE AS r FROM sides WHERE ref = 1 GROUP BY 1)
       FULL JOIN (SELECT product, count(*) / (SELECT count(*) FROM sides WHERE ref = 0)::DOUBLE AS c FROM sides WHERE ref = 0 GROUP BY 1) USING (product)""", _SIDES)  # fmt: skip
def full_outer_distribution_alignment(spark, sf_dir):
    both = sides(spark, sf_dir)

    def share(of: Column, name: str) -> DataFrame:
        by = both.filter(of).groupBy("product").agg(F.count("*").alias("n"))
        return by.select("product", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))  # a row a product

    floor = lambda c: r6(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-8))).alias(c)
    return share(F.col("is_reference"), "reference").join(share(~F.col("is_reference"), "current"), "product", "full").select("product", floor("reference"), floor("current"))


# ---- feedback ----


@query("""SELECT transaction_id, round(w, 6) AS weighted_confidence, round(t, 6) AS temporal_weight, round(q, 6) AS quality, round(least(1.0::DOUBLE, q * t), 6) AS training_weight, round(q, 6) > 0.7 AND consensus > 0.8 AS include FROM (
       SELECT transaction_id, consensus, sum(confidence * accuracy) / sum(accuracy) AS w, avg(exp(-(epoch_us(m) - epoch_us(given)) / 3600000000.0::DOUBLE / 24)) AS t,
       least(1.0::DOUBLE, (consensus + least(0.2::DOUBLE, count(*) * 0.1::DOUBLE)) * avg(accuracy) * avg(confidence)) AS q FROM fb JOIN agreed USING (transaction_id), (SELECT max(ts) AS m FROM txn) GROUP BY 1, 2)""", _CONSENSUS)  # fmt: skip
def training_weight(spark, sf_dir):
    as_of = transactions(spark, sf_dir).agg(F.max("ts").alias("as_of"))
    w = feedback.weights(given(spark, sf_dir), as_of)
    return w.select("transaction_id", *[r6(c).alias(c) for c in ("weighted_confidence", "temporal_weight", "quality", "training_weight")], "include")


@query("SELECT transaction_id, CASE WHEN agreed.label = 'fraud' THEN 1 ELSE 0 END AS label, round(fraud_score, 6) AS prediction, amount FROM agreed JOIN alerts USING (transaction_id)", _CONSENSUS)
def training_batch(spark, sf_dir):
    agreed = feedback.consensus(given(spark, sf_dir)).select("transaction_id", (F.col("label") == "fraud").cast("int").alias("label"))
    return alerts(spark, sf_dir).select("transaction_id", r6("fraud_score").alias("prediction"), "amount").join(agreed, "transaction_id")


@query("SELECT transaction_id, label, 'feedback' AS origin FROM (SELECT transaction_id, CASE WHEN label = 'fraud' THEN 1 ELSE 0 END AS label FROM agreed) UNION ALL SELECT transaction_id, is_fraud, 'history' FROM txn", _CONSENSUS)
def union_of_training_batches(spark, sf_dir):
    new = training_batch(spark, sf_dir).withColumn("origin", F.lit("feedback"))
    old = transactions(spark, sf_dir).select("transaction_id", F.col("is_fraud").alias("label"), F.lit("history").alias("origin"))
    return new.unionByName(old, allowMissingColumns=True).select("transaction_id", "label", "origin")


@query("""SELECT transaction_id, consensus FROM agreed JOIN (SELECT transaction_id, max(given) AS newest FROM fb, (SELECT max(ts) AS t FROM txn) GROUP BY 1
       HAVING (count(*) >= 2 OR max(given) <= any_value(t) - INTERVAL 1 HOUR) AND min(given) >= any_value(t) - INTERVAL 72 HOUR) USING (transaction_id) ORDER BY newest DESC, transaction_id DESC LIMIT 1000""", _CONSENSUS)  # fmt: skip
def training_feedback(spark, sf_dir, limit: int = 1000):
    """The eligible transactions with the newest feedback."""
    fb = given(spark, sf_dir)
    as_of = transactions(spark, sf_dir).agg(F.max("ts").alias("as_of"))
    may = feedback.eligible(fb, as_of).select("transaction_id").join(fb.groupBy("transaction_id").agg(F.max("given").alias("at")), "transaction_id")
    return feedback.consensus(fb).join(may, "transaction_id").orderBy(F.desc("at"), F.desc("transaction_id")).limit(limit).select("transaction_id", "consensus")


# ---- metric histories ----

_DAILY = sql.SCORED + ", daily_metrics AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, avg(CAST((round(fraud_score, 6) >= 0.3) = (is_fraud = 1) AS INT)) AS accuracy, avg(amount) AS latency, avg(is_fraud) AS rate FROM scored GROUP BY 1)"


def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = ((F.round("fraud_score", 6) >= 0.3) == (F.col("is_fraud") == 1)).cast("int")
    return scored(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg("amount").alias("latency"), F.avg("is_fraud").alias("rate"))


_ENDS = ", ends AS (SELECT avg(accuracy) FILTER (WHERE a <= m) AS head, avg(accuracy) FILTER (WHERE z <= m) AS tail, var_samp(accuracy) FILTER (WHERE a <= m) AS vh, var_samp(accuracy) FILTER (WHERE z <= m) AS vt, any_value(m) AS m, count(*) AS n FROM (SELECT *, greatest(2, floor(0.2::DOUBLE * count(*) OVER ())) AS m, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS z FROM daily_metrics))"


@query("SELECT round(head, 6) AS head, round(tail, 6) AS tail, round(head - tail, 6) AS dropped FROM ends WHERE n >= 10", _DAILY + _ENDS)
def head_tail_comparison(spark, sf_dir):
    return metrics.head_tail(daily_metrics(spark, sf_dir), "date", "accuracy").select(r6("head").alias("head"), r6("tail").alias("tail"), r6(F.col("head") - F.col("tail")).alias("dropped"))


@query("SELECT round(head - tail, 6) AS dropped, round((head - tail) / sqrt((vh + vt) / 2 * 2 / m), 4) AS t, head - tail > 0.05 AS large FROM ends WHERE n >= 10", _DAILY + _ENDS)
def performance_drift(spark, sf_dir):
    d = F.col("head") - F.col("tail")
    one = metrics.head_tail(daily_metrics(spark, sf_dir), "date", "accuracy")
    return one.select(r6(d).alias("dropped"), F.round(d / F.sqrt((F.col("head_var") + F.col("tail_var")) / 2 * 2 / F.col("m")), 4).alias("t"), (d > 0.05).alias("large"))


@query("""SELECT product, round(lr / lc, 6) AS latency_factor, round(nc / nr, 6) AS throughput_factor, round(ec - er, 6) AS error_change, lc > 1.1::DOUBLE * lr OR nc < 0.9::DOUBLE * nr OR ec > er + 0.01::DOUBLE AS regressed FROM (
       SELECT product, avg(amount) FILTER (WHERE ref = 1) AS lr, avg(amount) FILTER (WHERE ref = 0) AS lc, count(*) FILTER (WHERE ref = 1)::DOUBLE AS nr, count(*) FILTER (WHERE ref = 0)::DOUBLE AS nc,
       avg(is_fraud) FILTER (WHERE ref = 1) AS er, avg(is_fraud) FILTER (WHERE ref = 0) AS ec FROM sides GROUP BY 1)""", _SIDES)  # fmt: skip
def run_comparison(spark, sf_dir):
    return metrics.runs(sides(spark, sf_dir), "product", latency="amount", error="is_fraud").select(
        "product", r6("latency_factor").alias("latency_factor"), r6("throughput_factor").alias("throughput_factor"), r6("error_change").alias("error_change"), "regressed")


@query("""SELECT date, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT date, n::DOUBLE AS volume, accuracy, latency, rate FROM daily_metrics) ON volume, accuracy, latency, rate INTO NAME metric VALUE value)""", _DAILY)
def model_performance_by_period(spark, sf_dir):
    wide = daily_metrics(spark, sf_dir).withColumn("volume", F.col("n").cast("double"))
    return wide.unpivot("date", ["volume", "accuracy", "latency", "rate"], "metric", "value").withColumn("value", r6("value"))


@query("SELECT transaction_id, round(fraud_score, 6) AS fraud_score FROM scored ORDER BY ts DESC, transaction_id DESC LIMIT 1000", sql.SCORED)
def bounded_current_window(spark, sf_dir, n: int = 1000):
    last = scored(spark, sf_dir).select("transaction_id", "ts", "fraud_score").orderBy(F.desc("ts"), F.desc("transaction_id")).limit(n)
    return last.select("transaction_id", r6("fraud_score").alias("fraud_score"))


_TOP = ("product", "p_email", "device", "card1")


@query("SELECT name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS nth FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM txn WHERE {c} IS NOT NULL GROUP BY 2" for c in _TOP) + ")) WHERE nth <= 10")
def top_10_values_per_column(spark, sf_dir):
    t = transactions(spark, sf_dir).select(*[F.col(c).cast("string") for c in _TOP])
    counts = t.unpivot([], list(_TOP), "name", "value").filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter("nth <= 10").drop("nth")


@query("""SELECT 'amount' AS name, 'float' AS kind UNION ALL SELECT unnest(['transaction_id', 'user_id', 'k', 'is_fraud', 'card1', 'addr1', 'dt']), 'integer' UNION ALL SELECT 'ts', 'time'
       UNION ALL SELECT 'product', CASE WHEN bool_and(product IN ('T', 'F')) THEN 'boolean' ELSE 'categorical' END FROM txn UNION ALL SELECT 'device', CASE WHEN bool_and(device IN ('T', 'F')) THEN 'boolean' ELSE 'categorical' END FROM txn
       UNION ALL SELECT 'p_email', CASE WHEN bool_and(p_email IN ('T', 'F')) THEN 'boolean' ELSE 'categorical' END FROM txn""")  # fmt: skip
def column_typing(spark, sf_dir):
    return metrics.column_kinds(transactions(spark, sf_dir))


# ---- experiments and tests ----


@query("""SELECT round(pt - pc, 6) AS effect, round((pt - pc) / sqrt(p * (1 - p) * (1 / nc + 1 / nt)), 4) AS z FROM (SELECT tc / nc AS pc, tt / nt AS pt, (tc + tt) / (nc + nt) AS p, nc, nt FROM (
       SELECT count(*) FILTER (WHERE variant = 'control' AND said)::DOUBLE AS nc, count(*) FILTER (WHERE variant = 'treatment' AND said)::DOUBLE AS nt, count(*) FILTER (WHERE variant = 'control' AND said AND is_fraud = 1) AS tc,
       count(*) FILTER (WHERE variant = 'treatment' AND said AND is_fraud = 1) AS tt FROM assigned))""", _VARIANT)  # fmt: skip
def two_proportion_test(spark, sf_dir):
    t = experiments.precision_test(variant_scorecard(spark, sf_dir))
    return t.select(r6("effect").alias("effect"), F.round("z", 4).alias("z"))


@query("""SELECT predictions, CASE WHEN least(nc, nt) < 50 THEN 'insufficient' WHEN abs(z) > 1.959964 THEN CASE WHEN z > 0 THEN 'treatment' ELSE 'control' END ELSE 'no difference' END AS decision,
       least(nc, nt) >= 50 AND abs(z) > 1.959964 OR abs(effect) < 0.1 AND predictions > 500 AS stop FROM (SELECT *, (pt - pc) AS effect, (pt - pc) / sqrt(p * (1 - p) * (1 / nc + 1 / nt)) AS z FROM (
       SELECT tc / nc AS pc, tt / nt AS pt, (tc + tt) / (nc + nt) AS p, nc, nt, predictions FROM (SELECT count(*) AS predictions, count(*) FILTER (WHERE variant = 'control' AND said)::DOUBLE AS nc,
       count(*) FILTER (WHERE variant = 'treatment' AND said)::DOUBLE AS nt, count(*) FILTER (WHERE variant = 'control' AND said AND is_fraud = 1) AS tc, count(*) FILTER (WHERE variant = 'treatment' AND said AND is_fraud = 1) AS tt FROM assigned)))""", _VARIANT)  # fmt: skip
def experiment_report(spark, sf_dir):
    return experiments.report(variant_scorecard(spark, sf_dir), target=1000).select("predictions", "decision", "stop")


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 3) AS t FROM (SELECT fraud_score - ml_prediction AS d FROM scored)", sql.SCORED)
def paired_t_test_of_scores(spark, sf_dir):
    return evaluation.paired_t(scored(spark, sf_dir), "fraud_score", "ml_prediction").select("n", r6("mean").alias("mean"), F.round("t", 3).alias("t"))
