"""Alerts: severity, the user's alert history, sticky risk and the recommended response."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators.quantiles import running_sum


def alert_severity(score: Column, amount: Column) -> Column:
    """Ordered tests; a high score whose inner test fails goes on to the tests below it."""
    s = F.round(score, 6)
    flags = sum((F.col(c).cast("int") for c in ("is_high_amount", "is_unusual_hour", "is_rapid")), (F.col("velocity") > 5).cast("int"))
    high = ((s >= 0.7) | ((amount >= 1000) & (s >= 0.5))) & (F.col("is_rapid") | (F.col("velocity") > 15))
    return F.when(s >= 0.9, "CRITICAL").when(high, "HIGH").when((s >= 0.4) & (flags >= 2), "MEDIUM").otherwise("LOW")


def alerts(scored: DataFrame, threshold: float = 0.3, scale: float = 1.5) -> DataFrame:
    kept = scored.filter(F.round("fraud_score", 6) >= threshold).withColumn("fraud_score", F.least(F.lit(scale) * F.col("fraud_score"), F.lit(1.0)))
    return kept.withColumn("severity", alert_severity(F.col("fraud_score"), F.col("amount")))


def history(found: DataFrame) -> DataFrame:
    """Counts in the 24 hours and 7 days before, mean score in the 30 days before, and what follows from them."""
    by_time = Window.partitionBy("user_id").orderBy(F.unix_micros("ts"))
    back = lambda seconds: by_time.rangeBetween(-seconds * 1_000_000, -1)
    mean = F.coalesce(F.avg("fraud_score").over(back(30 * 86_400)), F.lit(0.0))
    out = found.withColumns({"alerts_24h": F.count("*").over(back(86_400)), "alerts_7d": F.count("*").over(back(7 * 86_400)), "mean_score": mean})
    return out.withColumns({"is_repeat": F.col("alerts_7d") >= 3, "is_escalating": F.round("fraud_score", 6) > F.round(1.5 * F.col("mean_score"), 6)})


def sticky_risk(found: DataFrame) -> DataFrame:
    """The user's level before and after each alert; high is never lowered."""
    u = Window.partitionBy("user_id").orderBy("ts", "transaction_id")
    nth = found.withColumn("nth", F.row_number().over(u))
    trigger = ((F.col("severity") == "CRITICAL") | ((F.col("severity") == "HIGH") & (F.col("nth") >= 3)) | (F.col("nth") >= 10)).cast("int")
    upto = nth.withColumn("_t", trigger).withColumn("_after", F.max("_t").over(u.rowsBetween(Window.unboundedPreceding, 0)))
    named = lambda c: F.when(c == 1, "high").otherwise("medium")
    return upto.withColumns({"risk_after": named(F.col("_after")), "risk_before": named(F.coalesce(F.lag("_after").over(u), F.lit(0)))}).drop("_t", "_after")


def response(found: DataFrame) -> DataFrame:
    """action and action_confidence, for alerts with history and risk_before."""
    s = F.round("fraud_score", 6)
    choice = lambda a, c: F.struct(F.lit(a).alias("action"), F.lit(c).alias("action_confidence"))
    made = (
        F.when((s >= 0.9) | ((s >= 0.7) & F.col("is_repeat")), choice("immediate_block", 0.95))
        .when((s >= 0.8) & (F.col("alerts_24h") >= 3), choice("auto_investigate", 0.9))
        .when(s >= 0.8, choice("manual_review", 0.85))
        .when((s >= 0.6) & ((F.col("risk_before") == "high") | (F.col("alerts_24h") >= 2)), choice("manual_review", 0.8))
        .when(s >= 0.6, choice("notify_team", 0.75))
        .when(F.col("is_repeat") | (F.col("alerts_24h") >= 5), choice("escalate", 0.7))
        .when(s >= 0.3, choice("notify_team", 0.6))
        .otherwise(choice("log_only", 0.5))
    )
    return found.withColumn("_r", made).select("*", "_r.*").drop("_r")


def routed(found: DataFrame) -> DataFrame:
    """priority, expires_at and whether the user is blocked, for alerts with an action."""
    action = F.col("action")
    later = lambda days: F.col("ts") + F.expr(f"interval {days} days")
    until = F.when(action == "immediate_block", later(1)).when(action == "auto_investigate", later(7)).when(action == "manual_review", later(3))
    urgent, usual = action.isin("auto_investigate", "escalate", "immediate_block"), action.isin("manual_review", "notify_team")
    priority = F.when(urgent, "high").when(usual, "medium").otherwise("low")
    return found.withColumns({"expires_at": until, "priority": priority, "blocks": action == "immediate_block"})


#: Fixed values of each action: its queue, the item's name, who or what it goes to, its status and reason, and the hours it holds.
DETAILS = {
    "immediate_block": ("blocked_users", "block", "auto_system", "blocked", "fraud_alert", 24),
    "auto_investigate": ("investigation_queue", "inv", "auto_investigator", "pending", "high_risk", 168),
    "manual_review": ("manual_review_queue", "review", "human_review", "pending", "review", 72),
    "escalate": ("escalations", "escalation", "senior_fraud_team", "sent", "repeat_offender_pattern", None),
    "notify_team": ("notifications", "notice", "email", "sent", "moderate_alert", None),
    "log_only": ("log", "entry", "info", "logged", "low_risk", None),
}


def details(routed: DataFrame) -> DataFrame:
    """A row for each routed alert as its queue holds it: queue, item, transaction_id, user_id, position (in its queue, from 1), detail (to, status, reason, hours, expires_at, fraud_score) and ts."""
    fields = ("queue", "name", "to", "status", "reason", "hours")
    made = F.lit(None)
    for action, values in reversed(DETAILS.items()):
        made = F.when(F.col("action") == action, F.struct(*[F.lit(v).cast("int" if n == "hours" else "string").alias(n) for n, v in zip(fields, values, strict=True)])).otherwise(made)
    own = routed.withColumn("_d", made).withColumn("queue", F.col("_d.queue"))
    placed = running_sum(own.select("transaction_id", "user_id", "ts", "queue", "fraud_score", "expires_at", "_d"), ["queue"], F.lit(1), "position")
    item = F.concat(F.col("_d.name"), F.lit("_"), F.col("transaction_id").cast("string"))
    detail = F.struct("_d.to", "_d.status", "_d.reason", "_d.hours", "expires_at", F.round("fraud_score", 6).alias("fraud_score"))
    return placed.select("queue", item.alias("item"), "transaction_id", "user_id", F.col("position").cast("long").alias("position"), detail.alias("detail"), "ts")


def notifications(routed: DataFrame) -> DataFrame:
    """subject and message of each routed alert that anyone is told of."""
    subject = F.format_string("Fraud alert: user %s", F.col("user_id").cast("string"))
    message = F.format_string("%s alert of transaction %s, action %s", F.col("severity"), F.col("transaction_id").cast("string"), F.col("action"))
    return routed.filter("action <> 'log_only'").withColumns({"subject": subject, "message": message})


def told(found: DataFrame, keys: tuple[str, ...] = ("user_id", "severity"), quiet_seconds: int = 3600) -> DataFrame:
    """The alerts whose key's last told alert is more than quiet_seconds old; the first of a key is told.

    After a gap of more than quiet_seconds an alert is told whatever came before, so alerts between such gaps are dealt over tasks of their own; a
    task reads each run in order of time and keeps the last told time only.
    """
    u = Window.partitionBy(*keys).orderBy("ts", "transaction_id")
    us = F.unix_micros("ts")
    gap = F.coalesce(us - F.lag(us).over(u) > quiet_seconds * 1_000_000, F.lit(True)).cast("int")
    runs = found.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(u.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    order = [*keys, "_run", "ts", "transaction_id"]
    own = runs.select(*order, us.alias("_us")).repartition(*keys, "_run").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, 0
        for b in batches:
            kept = []
            for key, at, i in zip(zip(*(b.column(k).to_pylist() for k in range(len(keys) + 1)), strict=True), b.column(len(keys) + 3).to_pylist(), b.column(len(keys) + 2).to_pylist(), strict=True):
                if key != of or at - last > quiet_seconds * 1_000_000:
                    kept.append(i)
                    of, last = key, at
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], ["transaction_id"])

    return found.join(own.mapInArrow(run, "transaction_id long"), "transaction_id", "left_semi")


def seconds_allowed(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 1).when(severity == "HIGH", 5).when(severity == "MEDIUM", 30).otherwise(300)


def status_of(log: DataFrame) -> DataFrame:
    """The last status of each alert in a log (transaction_id, status, at), and when it first had each kind of status."""
    first = lambda *of: F.min(F.when(F.col("status").isin(*of), F.col("at")))
    last = lambda *of: F.max(F.when(F.col("status").isin(*of), F.col("at")))
    return log.groupBy("transaction_id").agg(
        F.max_by("status", "at").alias("status"),
        first("PENDING").alias("pending_at"),
        first("INVESTIGATING").alias("investigating_at"),
        last("RESOLVED", "FALSE_POSITIVE").alias("resolved_at"),
    )


def prior(found: DataFrame, days: int = 30, most: int = 50) -> DataFrame:
    """prior: the user's newest alerts before each one, in the days before it and at most so many."""
    rows = Window.partitionBy("user_id").orderBy("ts", "transaction_id").rowsBetween(-most, -1)
    seen = F.collect_list(F.struct("transaction_id", "ts", "fraud_score")).over(rows)
    recent = F.filter("_seen", lambda p: p["ts"] >= F.col("ts") - F.expr(f"interval {days} days"))
    return found.withColumn("_seen", seen).withColumn("prior", recent).drop("_seen")


def mean_of(items: str, field: str) -> Column:
    """The mean of a field of an array of structs; 0 if it is empty."""
    total = F.aggregate(items, F.lit(0.0), lambda s, p: s + p[field])
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0)
