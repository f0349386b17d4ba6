"""Streams against the same work on the whole table."""

import uuid

import pytest
from pyspark.sql import functions as F

from cardlake.sources.tables import transactions
from cardlake.streaming import live

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("txn"))
    transactions(spark, DIR).withColumn("ts", F.col("ts")).repartition(4).write.mode("overwrite").parquet(path)
    return path


def result(spark, stream, mode):
    name = "q" + uuid.uuid4().hex
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def source(spark, path):
    return live.files(spark, path, spark.read.parquet(path).schema)


@pytest.mark.parametrize("slide", [None, "20 minutes"])
def test_windows(spark, stored, slide):
    got = result(spark, live.statistics(source(spark, stored), slide=slide), "complete")
    w = F.window("ts", "60 minutes", slide) if slide else F.window("ts", "60 minutes")
    want = transactions(spark, DIR).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    assert sorted(map(tuple, got.select("start", "n").collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark, stored):
    got = result(spark, live.sessions(source(spark, stored)), "complete")
    assert got.agg(F.sum("n")).first()[0] == transactions(spark, DIR).count()


def test_repeats_are_dropped(spark, tmp_path):
    one = transactions(spark, DIR).limit(50)
    one.unionByName(one).coalesce(1).write.parquet(str(tmp_path / "twice"))
    got = result(spark, live.once(source(spark, str(tmp_path / "twice")), "transaction_id"), "append")
    assert got.count() == got.select("transaction_id").distinct().count() == 50


def test_labels_within_72_hours(spark, stored, tmp_path):
    late = F.when(F.col("transaction_id") % 2 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 100 hours"))
    labels = transactions(spark, DIR).select(F.col("transaction_id").alias("label_id"), "is_fraud", (F.col("ts") + late).alias("given")).withColumnRenamed("is_fraud", "label")
    labels.write.parquet(str(tmp_path / "labels"))
    got = result(spark, live.with_labels(source(spark, stored), source(spark, str(tmp_path / "labels"))), "append")
    assert got.count() == transactions(spark, DIR).filter("transaction_id % 2 = 0").count()


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Rows older than the watermark of the batches before; the listener tells how many."""
    from datetime import datetime, timedelta

    from cardlake.streaming import jobs

    seen = jobs.Progress()
    spark.streams.addListener(seen)
    try:
        for k, hour in enumerate((10, 14, 2)):  # the third file is late
            rows = [(k, 1, datetime(2024, 1, 1, hour) + timedelta(minutes=i), 1.0, 0) for i in range(5)]
            spark.createDataFrame(rows, "transaction_id long, user_id long, ts timestamp, amount double, is_fraud int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = live.files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
            live.run_once(live.statistics(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        import time

        for _ in range(50):
            if sum(x["late"] for x in seen.seen):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert sum(x["late"] for x in seen.seen) > 0
    assert 2 not in {r.start.hour for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_a_batch_that_fails_after_writing_is_written_once(spark, stored, tmp_path):
    from cardlake.streaming import jobs

    out, failed = str(tmp_path / "rows"), []

    def write(batch, number):
        jobs.write_batch(batch.select("transaction_id"), out, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        jobs.run(source(spark, stored), write, str(tmp_path / "checkpoint"))
    jobs.run(source(spark, stored), write, str(tmp_path / "checkpoint"))
    got = jobs.read_batches(spark, out, "transaction_id long")
    assert jobs.committed_batches(spark, out) == [0]
    assert failed and got.count() == got.distinct().count() == transactions(spark, DIR).count()


def test_alarms(spark):
    from cardlake.streaming import jobs

    m = spark.createDataFrame([(0, 1000, 5, 10.0), (1, 1000, 50, 10.0), (2, 1000, 0, 5000.0), (3, 0, 0, 10.0)], jobs.METRICS)
    assert sorted(map(tuple, jobs.alarms(m).collect())) == [(1, "error_rate"), (2, "throughput")]


def test_alarms_of_a_running_stream(spark, tmp_path):
    """Three bad triggers raise an alarm, three good ones clear it; what the listener saw stands in a table, once."""
    import os
    import time

    from cardlake.sources.versions import Table
    from cardlake.streaming import jobs

    plan = [(1, True)] * 3 + [(4000, False), (1, True), (4000, False), (4000, False), (4000, False)]  # rows and whether they are bad
    (tmp_path / "in").mkdir()
    for k, (n, bad) in enumerate(plan):
        spark.range(n).select("id", F.lit(bad).alias("bad")).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        for f in (tmp_path / f"w{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
            os.utime(tmp_path / "in" / f"{k}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    seen = jobs.Progress(Table(spark, str(tmp_path / "progress"), jobs.PROGRESS))
    spark.streams.addListener(seen)
    try:
        stream = live.files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, per_trigger=1).observe("quality", F.count_if("bad").alias("bad"))
        jobs.run(stream, lambda b, n: b.write.format("noop").mode("overwrite").save(), str(tmp_path / "checkpoint"))
        for _ in range(100):
            if sum(x["rows"] for x in seen.seen) == sum(n for n, _ in plan):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    seen.flush()
    seen.flush()
    table = seen.table.read()
    assert [r["bad"] for r in table.filter("rows > 0").orderBy("batch").collect()] == [n * bad for n, bad in plan]
    got = {a: [r for r in jobs.alarm_states(table, {"throughput": 50.0}).orderBy("batch").collect() if r["alarm"] == a] for a in jobs.LIMITS}
    for a in ("error_rate", "throughput"):
        assert [r["is_bad"] for r in got[a]] == [True] * 3 + [False, True] + [False] * 3
        assert [r["raised"] for r in got[a]] == [False, False] + [True] * 5 + [False]
        assert [r["batch"] for r in got[a] if r["turned"]] == [2, 7]
    assert not any(r["raised"] for r in got["lag"])
    lagging = table.withColumn("lag", F.when(F.col("batch") < 4, 20_000).otherwise(0))
    assert [r["batch"] for r in jobs.alarm_states(lagging).filter("alarm = 'lag' and turned").orderBy("batch").collect()] == [2, 6]


def test_batches_by_time(spark, stored, tmp_path):
    """With an interval the query goes on: a file that comes later is worked off by a later batch."""
    import shutil
    import time
    from pathlib import Path

    from cardlake.streaming import jobs

    out, path = str(tmp_path / "rows"), tmp_path / "in"
    files = sorted(Path(stored).glob("part-*"))
    path.mkdir()
    shutil.copy(files[0], path / files[0].name)
    stream = live.files(spark, str(path), spark.read.parquet(stored).schema)
    query = jobs.run(stream, lambda b, n: jobs.write_batch(b.select("transaction_id"), out, n), str(tmp_path / "checkpoint"), every="1 second")
    try:
        for k, want in enumerate((spark.read.parquet(str(files[0])).count(), sum(spark.read.parquet(str(f)).count() for f in files[:2]))):
            for _ in range(150):
                if jobs.read_batches(spark, out, "transaction_id long").count() == want:
                    break
                time.sleep(0.2)
            assert jobs.read_batches(spark, out, "transaction_id long").count() == want and len(jobs.committed_batches(spark, out)) == k + 1
            if not k:
                shutil.copy(files[1], path / files[1].name)
    finally:
        query.stop()
