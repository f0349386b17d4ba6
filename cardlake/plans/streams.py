"""Registered queries that run as streams over messages or tables written from the stored events, and return what their sinks hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.operators import experiments
from cardlake.plans import sql
from cardlake.plans.decisions import _ACTION, responses
from cardlake.plans.monitoring import bucket_sql
from cardlake.plans.queries import _HISTORY, alerts, query, r6
from cardlake.plans.reports import _TESTS, drift_table, retrain_requests
from cardlake.sources import contracts, records
from cardlake.sources.tables import transactions
from cardlake.sources.versions import Table
from cardlake.streaming import jobs, live, state


def _message(topic: str, key: Column, *body: Column) -> list[Column]:
    return [F.lit(topic).alias("topic"), key.cast("string").alias("key"), F.to_json(F.struct(*body)).alias("value")]


def transaction_messages(txn: DataFrame) -> DataFrame:
    location, metadata = F.struct("addr1").alias("location"), F.create_map(F.lit("device"), F.col("device")).alias("metadata")
    return txn.select(*_message("transactions", F.col("user_id"), *[F.col(c) for c in ("transaction_id", "user_id", "ts", "amount", "product")], location, metadata))


def alert_messages(found: DataFrame) -> DataFrame:
    return records.alert_message(found).select(F.lit("alerts").alias("topic"), "key", "value")


def response_messages(found: DataFrame) -> DataFrame:
    return found.select(*_message("responses", F.col("user_id"), F.col("transaction_id"), F.col("action"), F.col("action_confidence")))


def audit_messages(found: DataFrame) -> DataFrame:
    a = jobs.audit_of(found)
    return a.select(*_message("audit", F.col("user_id"), *[F.col(c) for c in a.columns]))


def published(df: DataFrame, name: str) -> str:
    """The path of messages, written as files that a stream can read."""
    path = records.scratch(df.sparkSession, name)
    df.write.json(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = records.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path, live.files(df.sparkSession, path, df.schema)


def worked_off(stream: DataFrame, write: jobs.Write | None, out: str) -> str:
    jobs.run(stream, write or (lambda b, n: jobs.write_batch(b, f"{out}/rows", n)), f"{out}/checkpoint")
    return f"{out}/rows"


# ---- sources ----


@query("SELECT transaction_id, user_id, round(amount, 6) AS amount, product, addr1, device FROM txn")
def transaction_stream_source(spark, sf_dir):
    path = published(transaction_messages(transactions(spark, sf_dir)), "messages")
    v = contracts.decoded(jobs.messages(spark, path), contracts.TRANSACTION).filter("size(errors) = 0").select("v.*")
    rows = worked_off(v, None, records.scratch(spark, "transactions"))
    return jobs.read_batches(spark, rows, v.schema).select("transaction_id", "user_id", r6("amount").alias("amount"), "product", "location.addr1", F.col("metadata")["device"].alias("device"))


@query("""SELECT transaction_id, concat_ws(',', CASE WHEN transaction_id % 50 = 0 THEN 'missing_amount' END, CASE WHEN product = 'error' THEN 'unknown_product' END) AS errors FROM txn""")
def typed_event_contracts(spark, sf_dir):
    """Every 50th transaction has lost its amount, and errors are no product, so that contracts are broken."""
    txn = transactions(spark, sf_dir).withColumn("amount", F.when(F.col("transaction_id") % 50 != 0, F.col("amount")))
    found = contracts.decoded(transaction_messages(txn), contracts.TRANSACTION, {"product": ("click", "purchase", "signup", "view")})
    return found.select("v.transaction_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT 'alert_' || transaction_id AS alert_id, user_id, severity, round(fraud_score, 6) AS fraud_score, round(amount, 6) AS amount FROM alerts", sql.ALERTS)
def alert_stream_source(spark, sf_dir):
    path = published(alert_messages(alerts(spark, sf_dir)), "alerts")
    v = contracts.decoded(jobs.messages(spark, path), contracts.ALERT).filter("size(errors) = 0").select("v.*")
    rows = worked_off(v, None, records.scratch(spark, "alerts"))
    return jobs.read_batches(spark, rows, v.schema).select("alert_id", "user_id", "severity", "fraud_score", r6("transaction_details.amount").alias("amount"))


_ID = {"transactions": "transaction_id", "alerts": "alert_id", "responses": "transaction_id", "audit": "entity_id"}
_FIELD = {"transactions": "amount", "alerts": "severity", "responses": "action", "audit": "event"}


@query("""SELECT 'transactions' AS topic, CAST(user_id AS VARCHAR) AS key, CAST(transaction_id AS VARCHAR) AS id, CAST(round(amount, 2) AS DECIMAL(18, 2))::VARCHAR AS field FROM txn UNION ALL SELECT 'alerts', CAST(user_id AS VARCHAR), 'alert_' || transaction_id, severity FROM alerts
       UNION ALL SELECT 'responses', CAST(user_id AS VARCHAR), CAST(transaction_id AS VARCHAR), action FROM acted UNION ALL SELECT 'audit', CAST(user_id AS VARCHAR), CAST(transaction_id AS VARCHAR), 'alert_created' FROM alerts""", _ACTION)  # fmt: skip
def multi_topic_routing(spark, sf_dir):
    """Four topics in one stream, by micro-batches of a bounded number of files, each topic to a table of its own, whose messages are read again."""
    found = records.stored(alerts(spark, sf_dir), "alerts")
    every = transaction_messages(transactions(spark, sf_dir)).unionByName(alert_messages(found)).unionByName(audit_messages(found)).unionByName(response_messages(responses(spark, sf_dir)))
    stream, out = jobs.messages(spark, published(every, "topics"), files_per_trigger=4), records.scratch(spark, "topics")
    worked_off(stream, jobs.routed({t: lambda b: b for t in _ID}, out), out)
    parts = []
    for t, name in _ID.items():
        field = F.get_json_object("value", f"$.{_FIELD[t]}")
        field = field.cast("double").cast("decimal(18, 2)").cast("string") if t == "transactions" else field
        parts.append(jobs.read_batches(spark, f"{out}/{t}", jobs.MESSAGE).select("topic", "key", F.get_json_object("value", f"$.{name}").alias("id"), field.alias("field")))
    return reduce(DataFrame.unionByName, parts)


# ---- sinks ----


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE transaction_id % 50 = 0) AS bad FROM txn")
def metrics_sink(spark, sf_dir):
    """Rows and bad rows of each micro-batch, as the batch's sink writes them; every 50th message has lost its amount."""
    txn = transactions(spark, sf_dir).withColumn("amount", F.when(F.col("transaction_id") % 50 != 0, F.col("amount")))
    stream = contracts.decoded(jobs.messages(spark, published(transaction_messages(txn), "messages"), 4), contracts.TRANSACTION)
    out = records.scratch(spark, "metrics")
    worked_off(stream, jobs.measured(lambda b, n: jobs.write_batch(b.filter("size(errors) = 0").select("v.*"), f"{out}/rows", n), f"{out}/metrics"), out)
    return jobs.read_batches(spark, f"{out}/metrics", jobs.METRICS).agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


_HOURLY = """, hourly AS (SELECT epoch(date_trunc('hour', ts))::BIGINT // 3600 AS batch, count(*) AS rows, count(*) FILTER (WHERE product = 'error') AS bad, max(amount) AS ms, count(*) FILTER (WHERE k < 6) AS lag FROM txn GROUP BY 1),
bads AS (SELECT batch, 'lag' AS alarm, lag > 4 AS is_bad FROM hourly UNION ALL SELECT batch, 'error_rate', bad > 0.2::DOUBLE * rows FROM hourly UNION ALL SELECT batch, 'throughput', rows * 1000 < 100.0::DOUBLE * ms FROM hourly),
numbered AS (SELECT *, row_number() OVER (PARTITION BY alarm ORDER BY batch) AS i FROM bads),
steps AS (SELECT alarm, batch, i, is_bad, 1 AS streak, false AS raised, false AS turned FROM numbered WHERE i = 1
  UNION ALL SELECT n.alarm, n.batch, n.i, n.is_bad, CASE WHEN n.is_bad = s.is_bad THEN s.streak + 1 ELSE 1 END, CASE WHEN n.is_bad = s.is_bad AND s.streak + 1 >= 3 THEN n.is_bad ELSE s.raised END, n.is_bad = s.is_bad AND s.streak + 1 >= 3 AND n.is_bad <> s.raised
  FROM steps AS s JOIN numbered AS n ON n.alarm = s.alarm AND n.i = s.i + 1)"""


@query("SELECT batch, alarm, is_bad, raised, turned FROM steps", "RECURSIVE " + sql.TXN + _HOURLY)
def alarms_with_hysteresis(spark, sf_dir):
    """Hours stand for triggers: their errors are bad rows, the largest amount the milliseconds; three bad ones on end raise an alarm and three good ones clear it."""
    hour = F.floor(F.unix_seconds(F.date_trunc("hour", "ts")) / 3600)
    by = transactions(spark, sf_dir).groupBy(hour.alias("batch")).agg(F.count("*").alias("rows"), F.count_if(F.col("product") == "error").alias("bad"), F.max("amount").alias("milliseconds"), F.count_if(F.col("k") < 6).alias("lag"))
    return jobs.alarm_states(by, {"lag": 4.0, "error_rate": 0.2, "throughput": 100.0})


@query("SELECT transaction_id, user_id, action FROM acted", _ACTION)
def response_sink(spark, sf_dir):
    path, stream = stored(responses(spark, sf_dir).select("transaction_id", "user_id", "action", "action_confidence"), "responses")
    rows = worked_off(response_messages(stream), None, records.scratch(spark, "response-sink"))
    body = F.from_json("value", "transaction_id long, action string")
    return jobs.read_batches(spark, rows, jobs.MESSAGE).select(F.col("key").cast("long").alias("user_id"), body.alias("v")).select("v.transaction_id", "user_id", "v.action")


@query("""SELECT 'analytics' AS sink, transaction_id AS id, severity AS field FROM alerts UNION ALL SELECT 'alerts', transaction_id, severity FROM alerts WHERE severity <> 'LOW'
       UNION ALL SELECT 'audit', transaction_id, severity FROM alerts WHERE severity <> 'LOW' UNION ALL SELECT 'accounts', user_id, CAST(count(*) AS VARCHAR) FROM alerts WHERE severity <> 'LOW' GROUP BY user_id""", sql.ALERTS)  # fmt: skip
def severity_routed_sinks(spark, sf_dir):
    """What each sink holds: alerts by id and severity, audit rows by theirs, accounts by their number of alerts."""
    found = alerts(spark, sf_dir).select("transaction_id", "user_id", "ts", "severity", "fraud_score", "amount")
    _, stream = stored(found, "alerts")
    out = records.scratch(spark, "routed")
    worked_off(stream, jobs.by_severity(out), out)
    held = lambda name, schema, key, field: jobs.read_batches(spark, f"{out}/{name}", schema).select(F.lit(name).alias("sink"), F.col(key).cast("long").alias("id"), field.alias("field"))
    told = [held(n, found.schema, "transaction_id", F.col("severity")) for n in ("analytics", "alerts")]
    audit = held("audit", "entity_id string, details string", "entity_id", F.get_json_object("details", "$.severity"))
    totals = held("accounts", jobs.ACCOUNTS, "user_id", F.col("total_alerts")).groupBy("sink", "id").agg(F.sum("field").cast("string").alias("field"))
    return reduce(DataFrame.unionByName, [*told, audit, totals])


@query("SELECT user_id, count(*) AS total_alerts, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high_alerts, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'BLOCKED' ELSE 'ACTIVE' END AS status FROM alerts GROUP BY user_id", sql.ALERTS)
def account_snapshots(spark, sf_dir):
    """Accounts after the alerts of three micro-batches: counters add up, and a blocked account stays blocked."""
    found = alerts(spark, sf_dir).select("transaction_id", "user_id", "severity")
    path = records.scratch(spark, "alerts")
    found.repartition(3, "transaction_id").write.parquet(path)
    out = records.scratch(spark, "accounts")
    jobs.run(live.files(spark, path, found.schema, per_trigger=1), jobs.account_snapshots(f"{out}/rows", every=2), f"{out}/checkpoint")
    return jobs.accounts(spark, f"{out}/rows")


@query("SELECT 'alert_created' AS event, CAST(transaction_id AS VARCHAR) AS entity_id, user_id, ts AS at, severity, round(fraud_score, 5) AS fraud_score FROM alerts WHERE severity <> 'LOW'", sql.ALERTS)
def audit_append(spark, sf_dir):
    found = alerts(spark, sf_dir).filter("severity <> 'LOW'").select("transaction_id", "user_id", "ts", "severity", "fraud_score")
    _, stream = stored(found, "alerts")
    rows = worked_off(jobs.audit_of(stream), None, records.scratch(spark, "audit"))
    log = jobs.read_batches(spark, rows, "event string, entity_id string, user_id long, at timestamp, details string")
    score = F.round(F.get_json_object("details", "$.fraud_score").cast("double"), 5)
    return log.select("event", "entity_id", "user_id", F.col("at").cast("timestamp_ntz").alias("at"), F.get_json_object("details", "$.severity").alias("severity"), score.alias("fraud_score"))


@query("""SELECT 'drift_alert' AS event, test || ':' || feature AS subject, severity AS field FROM judged WHERE is_alert UNION ALL SELECT 'retrain_request', test || ':' || feature, CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END FROM judged WHERE retrain
       UNION ALL SELECT 'assignment', CAST(user_id AS VARCHAR), CAST(b AS VARCHAR) FROM """ + bucket_sql("exp_1"), _TESTS)  # fmt: skip
def event_sinks(spark, sf_dir):
    """Drift alerts, retrain requests and assignments, appended as versions of one table of events."""
    table = Table(spark, records.scratch(spark, "events"), "event string, body string")
    users = transactions(spark, sf_dir).select("user_id").distinct()
    parts = {"drift_alert": drift_table(spark, sf_dir).filter("is_alert"), "retrain_request": retrain_requests(spark, sf_dir), "assignment": users.select("user_id", experiments.bucket(F.col("user_id"), "exp_1").alias("bucket"))}
    for event, df in parts.items():
        table.append(df.select(F.lit(event).alias("event"), F.to_json(F.struct(*df.columns)).alias("body")), event)
    body = lambda c: F.get_json_object("body", f"$.{c}")
    subject = F.coalesce(body("user_id"), F.concat(body("test"), F.lit(":"), body("feature")))
    return table.read().select("event", subject.alias("subject"), F.coalesce(body("bucket"), body("priority"), body("severity")).alias("field"))


# ---- state and enrichment ----


def by_time(df: DataFrame, name: str, parts: int = 3) -> DataFrame:
    """df (with ts) as a stream of one file a trigger, each of a later range of time; files are taken by their time of change, so that is set in their order."""
    spark = df.sparkSession
    path = records.scratch(spark, name)
    df.repartitionByRange(parts, "ts").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted(((s.getPath().getName(), s) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda x: x[0])
    first = min((s.getModificationTime() for _, s in written), default=0) // 1000 * 1000
    for i, (_, s) in enumerate(written):
        fs.setTimes(s.getPath(), first - 1000 * (len(written) - i), -1)
    return live.files(spark, path, df.schema, per_trigger=1)


def _through(stream: DataFrame, processor: state.ByUser) -> DataFrame:
    """What a processor makes of the whole stream, some triggers."""
    out = records.scratch(stream.sparkSession, "state")
    live.run_once(state.by_user(stream, processor), f"{out}/rows", f"{out}/checkpoint")
    return stream.sparkSession.read.schema(processor.schema).parquet(f"{out}/rows")


@query("SELECT transaction_id, total_transactions, round(total_amount, 4) AS total_amount FROM feat", sql.PROFILE)
def stream_profiles(spark, sf_dir):
    """Profiles before each transaction, kept by user as state over three triggers."""
    found = _through(by_time(transactions(spark, sf_dir).select("transaction_id", "user_id", "ts", "amount"), "transactions"), state.Profiles())
    return found.withColumn("total_amount", F.round("total_amount", 4))


@query("SELECT transaction_id, nth, risk_before, risk_after FROM risk", _HISTORY)
def alert_state_stream(spark, sf_dir):
    return _through(by_time(alerts(spark, sf_dir).select("transaction_id", "user_id", "ts", "severity"), "alerts"), state.AlertRisk())


@query("""SELECT transaction_id, array_to_string(list_reverse(ids)[1:10], ',') AS recent, least(len(ids), 10)::INT AS n_recent FROM (SELECT transaction_id, list(transaction_id) OVER (PARTITION BY user_id, run ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS ids FROM (
       SELECT *, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, transaction_id)) AS gap FROM alerts)))""", sql.ALERTS)  # fmt: skip
def recent_alert_lists(spark, sf_dir):
    """With each alert its user's last ten, newest first, of a list that ends half an hour after the last."""
    return _through(by_time(alerts(spark, sf_dir).select("transaction_id", "user_id", "ts"), "alerts"), state.RecentAlerts())


_STATUS = sql.ALERTS + ", status AS (SELECT user_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'BLOCKED' ELSE 'ACTIVE' END AS status FROM alerts GROUP BY 1)"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.account_changes(alerts(spark, sf_dir)).select("user_id", "status")


@query("SELECT transaction_id, coalesce(status, 'UNKNOWN') AS status FROM txn LEFT JOIN status USING (user_id)", _STATUS)
def dimension_lookup(spark, sf_dir):
    return jobs.enriched(transactions(spark, sf_dir), statuses(spark, sf_dir)).select("transaction_id", "status")


@query("SELECT transaction_id, coalesce(status, 'UNKNOWN') AS status FROM txn LEFT JOIN status USING (user_id)", _STATUS)
def stream_enrichment(spark, sf_dir):
    table = records.stored(statuses(spark, sf_dir), "statuses")
    _, stream = stored(transactions(spark, sf_dir).select("transaction_id", "user_id"), "transactions")
    rows = worked_off(jobs.enriched(stream, table), None, records.scratch(spark, "enriched"))
    return jobs.read_batches(spark, rows, "transaction_id long, status string")
