"""Streaming jobs: messages of several topics to tables, accounts, enrichment, scoring, progress metrics and alarms.

Every write goes by batch to a table of sources.versions: a batch's rows become visible by one commit record, a batch that failed before it leaves nothing that readers see, and one that is
repeated after it writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from cardlake.operators import models
from cardlake.operators.features import as_of
from cardlake.sources.records import stored
from cardlake.sources.versions import Table

MESSAGE = "topic string, key string, value string"
Write = Callable[[DataFrame, int], None]


def messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """topic, key and value of messages stored as JSON lines. A broker's source has the same columns. files_per_trigger bounds a batch by size."""
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def broker_messages(spark: SparkSession, servers: str, topics: list[str], per_trigger: int = 100_000) -> DataFrame:
    """The same from a Kafka broker; needs the connector's package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "maxOffsetsPerTrigger": per_trigger, "failOnDataLoss": "true"}
    return spark.readStream.format("kafka").options(**options).load().selectExpr("topic", "cast(key as string) key", "cast(value as string) value")


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Commits a batch's rows, once."""
    Table(rows.sparkSession, path, rows.schema).append(rows, batch)


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that readers of the table see."""
    return sorted(map(int, Table(spark, path, StructType()).committed_batches()))


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed batches of a table; none gives an empty table."""
    return Table(spark, path, schema).read()


def routed(routes: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Write:
    """Writes a batch's messages to one table for each topic; the batch is kept while its topics are read one after the other."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for topic, made in routes.items():
                write_batch(made(batch.filter(F.col("topic") == topic)), f"{path}/{topic}", number)
        finally:
            batch.unpersist()

    return write


def by_severity(path: str) -> Write:
    """Alerts above LOW go to alerts, accounts and audit and to analytics, others to analytics only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            told = batch.filter("severity <> 'LOW'")
            write_batch(told, f"{path}/alerts", number)
            write_batch(account_changes(told), f"{path}/accounts", number)
            write_batch(audit_of(told), f"{path}/audit", number)
            write_batch(batch, f"{path}/analytics", number)
        finally:
            batch.unpersist()

    return write


def account_changes(alerts: DataFrame) -> DataFrame:
    high = F.col("severity").isin("HIGH", "CRITICAL")
    blocked = F.when(F.bool_or(F.col("severity") == "CRITICAL"), "BLOCKED").otherwise("ACTIVE")
    return alerts.groupBy("user_id").agg(F.count("*").alias("total_alerts"), F.count_if(high).alias("high_alerts"), blocked.alias("status"))


def upserted(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The accounts after changes (a row a user): counters add up, a new user starts with its change, and a status other than ACTIVE stays."""
    c, d = current.alias("c"), changes.alias("d")
    plus = lambda x: (F.coalesce(F.col(f"c.{x}"), F.lit(0)) + F.coalesce(F.col(f"d.{x}"), F.lit(0))).alias(x)
    status = F.when(F.col("c.status") != "ACTIVE", F.col("c.status")).otherwise(F.coalesce("d.status", "c.status"))
    return c.join(d, F.col("c.user_id").eqNullSafe(F.col("d.user_id")), "full").select(F.coalesce("c.user_id", "d.user_id").alias("user_id"), plus("total_alerts"), plus("high_alerts"), status.alias("status"))


ACCOUNTS = "user_id long, total_alerts long, high_alerts long, status string"
#: Batches of changes between whole snapshots of the accounts.
FOLD_EVERY = 10


def folded(changes: DataFrame) -> DataFrame:
    """The accounts after all changes (ACCOUNTS and batch): counters add up, and of statuses other than ACTIVE the first stays."""
    held = F.min_by("status", F.when(F.col("status") != "ACTIVE", F.col("batch")))
    return changes.groupBy("user_id").agg(F.sum("total_alerts").alias("total_alerts"), F.sum("high_alerts").alias("high_alerts"), F.coalesce(held, F.lit("ACTIVE")).alias("status"))


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """The accounts after the last committed batch: the last snapshot and the changes since."""
    return folded(Table(spark, path, ACCOUNTS + ", batch long").read())


def account_snapshots(path: str, every: int = FOLD_EVERY) -> Write:
    """Each batch of alerts adds its users' changes to the accounts; every so many batches what there is becomes one snapshot. A batch that does not follow the last committed one is an error."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, path, ACCOUNTS + ", batch long")
        done = [int(b) for b in table.committed_batches()]
        if number in done:
            return
        if number != (max(done) + 1 if done else 0):
            raise ValueError(f"batch {number} follows {max(done) if done else 'none'} in {path}: the accounts between are lost")
        changes = account_changes(batch).withColumn("batch", F.lit(number).cast("long"))
        if (number + 1) % every:
            table.append(changes, number)
        else:
            table.replace(folded(table.read().unionByName(changes)).withColumn("batch", F.lit(number).cast("long")), number)

    return write


def audit_of(alerts: DataFrame) -> DataFrame:
    """What happened, to whom and when, as rows that are only ever added."""
    details = F.to_json(F.struct("severity", F.round("fraud_score", 6).alias("fraud_score")))
    return alerts.select(F.lit("alert_created").alias("event"), F.lit("fraud_alert").alias("entity"), F.col("transaction_id").cast("string").alias("entity_id"), "user_id", F.col("ts").alias("at"), details.alias("details"))


def run(stream: DataFrame, write: Write, checkpoint: str, every: str | None = None):
    """Works off what there is and returns the query; with every, goes on by batches at that interval."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def enriched(stream: DataFrame, status: DataFrame) -> DataFrame:
    """A stream of transactions with each user's status (user_id, status) from a table, which is read anew by each batch; UNKNOWN for users it lacks."""
    return stream.join(status, "user_id", "left").withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


DEPLOYMENTS = "version string, since timestamp, path string"
SCORES = "transaction_id long, version string, is_model boolean, score double"


def scored_by_version(log: Table, path: str, fallback: Column) -> Write:
    """Scores each batch by the model version deployed at each row's time, as the log of deployments stands when the batch begins; so a deployment between two batches counts from the next one on.

    A version whose log entry has no path, and rows before the first deployment, get the fallback. A batch scores each version's rows by themselves: versions are those of the log, few.
    """
    loaded: dict[str, PipelineModel] = {}

    def write(batch: DataFrame, number: int) -> None:
        now = log.read()
        rows = stored(as_of(batch, now.withColumn("active", F.struct("version", "path")), "since", "active"), "to-score")
        parts = []
        for version, at in [(r[0], r[1]) for r in rows.select("active.version", "active.path").distinct().collect()]:
            if at is not None and at not in loaded:
                loaded[at] = PipelineModel.load(at)
            own = rows.filter(F.col("active.version").eqNullSafe(F.lit(version)) & F.col("active.path").eqNullSafe(F.lit(at)))
            made = models.score(own, loaded.get(at), fallback)
            parts.append(made.select("transaction_id", F.lit(version).cast("string").alias("version"), F.lit(at is not None).alias("is_model"), "score"))
        if parts:
            write_batch(reduce(DataFrame.unionByName, parts), path, number)

    return write


def measured(write: Write, path: str, errors: str = "size(errors) > 0") -> Write:
    """write, and a row of metrics for each batch: rows, bad rows and milliseconds."""
    import time

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            started = time.monotonic()
            write(batch, number)
            n = batch.agg(F.count("*").alias("rows"), F.count_if(F.expr(errors)).alias("bad"))
            ms = F.lit((time.monotonic() - started) * 1000)
            write_batch(n.select(F.lit(number).cast("long").alias("batch"), "rows", "bad", ms.alias("milliseconds")), path, number)
        finally:
            batch.unpersist()

    return both


METRICS = "batch long, rows long, bad long, milliseconds double"


def alarms(metrics: DataFrame, most_errors: float = 0.01, least_per_second: float = 1000.0) -> DataFrame:
    """batch and alarm for batches with too many errors or too slow."""
    found = F.array_compact(F.array(F.when(F.col("bad") > most_errors * F.col("rows"), "error_rate"), F.when(F.col("rows") * 1000 < least_per_second * F.col("milliseconds"), "throughput")))
    return metrics.filter("rows > 0").select("batch", F.explode(found).alias("alarm"))


#: What the listener tells of a trigger. LIMITS: lag, share of bad rows, rows a second.
PROGRESS = "query string, batch long, rows long, bad long, milliseconds double, late long, lag long"
LIMITS = {"lag": 10_000.0, "error_rate": 0.01, "throughput": 1000.0}


def alarm_states(metrics: DataFrame, limits: dict[str, float] | None = None, after: int = 3) -> DataFrame:
    """batch, alarm, is_bad, raised and turned (raised or cleared just then) for each trigger with rows and alarm. An alarm is raised after so many bad triggers on end and cleared after so many good ones.

    metrics: batch, rows, bad, milliseconds and lag; a row a trigger, so that windows hold triggers and not data.
    """
    most = LIMITS | (limits or {})
    bad = {"lag": F.col("lag") > most["lag"], "error_rate": F.col("bad") > most["error_rate"] * F.col("rows"), "throughput": F.col("rows") * 1000 < most["throughput"] * F.col("milliseconds")}
    long = metrics.filter("rows > 0").select("batch", F.inline(F.array(*[F.struct(F.lit(n).alias("alarm"), F.coalesce(c, F.lit(False)).alias("is_bad")) for n, c in bad.items()])))
    w = Window.partitionBy("alarm").orderBy("batch")
    run = long.withColumn("_new", F.coalesce((F.col("is_bad") != F.lag("is_bad").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    nth = run.withColumn("_nth", F.row_number().over(Window.partitionBy("alarm", "_run").orderBy("batch")))
    state = nth.withColumn("raised", F.coalesce(F.last(F.when(F.col("_nth") >= after, F.col("is_bad")), True).over(w), F.lit(False)))
    return state.select("batch", "alarm", "is_bad", "raised", (F.col("raised") != F.coalesce(F.lag("raised").over(w), F.lit(False))).alias("turned"))


class Progress(StreamingQueryListener):
    """Keeps what each trigger tells and appends it to a table of PROGRESS, once a trigger, when flush() is called. counted: a query's observed count of bad rows, as name and column."""

    def __init__(self, table: Table | None = None, counted: tuple[str, str] = ("quality", "bad")) -> None:
        self.table, self.counted, self.seen, self._told = table, counted, [], 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        lag = max((int(float(s.metrics.get("maxOffsetsBehindLatest", 0))) for s in p.sources), default=0)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        found = p.observedMetrics.get(self.counted[0])
        bad = int(found[self.counted[1]] or 0) if found is not None else 0
        self.seen.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "bad": bad, "milliseconds": float(p.batchDuration), "late": late, "lag": lag})

    def flush(self) -> None:
        """Appends what the table lacks."""
        new, self._told = self.seen[self._told :], len(self.seen)
        if new and self.table:
            names = [f.split()[0] for f in PROGRESS.split(", ")]
            rows = self.table.spark.createDataFrame([tuple(x[n] for n in names) for x in new], PROGRESS)
            self.table.append(rows, f"{new[0]['query']}:{new[0]['batch']}-{new[-1]['batch']}")

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass
