"""State by user over several triggers: one user with a third of all rows, small blocks, and the order of rows."""

import random
from datetime import datetime, timedelta

import pytest

from cardlake.streaming import live, state


class Blocks(dict):
    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    getValue = dict.__getitem__  # noqa: N815
    removeKey = dict.pop  # noqa: N815


@pytest.mark.parametrize("frames", [0, 1, 2, 23])
def test_rows_come_in_order_in_bounded_memory(frames):
    dice, most = random.Random(4), 0
    rows = [[(dice.randrange(50), dice.randrange(10**6), float("nan") if dice.random() < 0.1 else 1.5) for _ in range(dice.randrange(1, 40))] for _ in range(frames)]
    blocks, got = Blocks(), []
    for row in state.InOrder(blocks, block=4, fan=3).of(iter(rows)):
        got.append(row[:2])
        most = max(most, len(blocks))
    assert got == sorted(r[:2] for part in rows for r in part) and not blocks
    assert all(len(v[0]) < 400 for v in blocks.values()) and (most > 0) == (frames > 1)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """User 0 has a third of all rows; three files of later and later rows."""
    dice, path = random.Random(6), tmp_path_factory.mktemp("hot")
    start, n = datetime(2024, 1, 1), 900
    rows = [(i, 0 if i % 3 == 0 else dice.randrange(1, 40), start + timedelta(seconds=40 * i + dice.randrange(30)), float(i % 17), dice.choice(["LOW", "LOW", "HIGH"] + ["CRITICAL"] * (i > 800))) for i in range(n)]
    schema = "transaction_id long, user_id long, ts timestamp, amount double, severity string"
    import os

    for k in range(3):
        part = rows[300 * k : 300 * k + 300]
        dice.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"in{k}"))
        (path / "in").mkdir(exist_ok=True)
        for f in (path / f"in{k}").glob("part-*"):
            to = path / "in" / f"{k}-{f.name}"
            f.rename(to)
            os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(path / "in"), sorted(rows, key=lambda r: (r[2], r[0])), schema


def through(spark, hot, tmp_path, processor):
    from pyspark.sql.types import StructType

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        stream = live.files(spark, hot[0], StructType.fromDDL(hot[2]), per_trigger=1)
        live.run_once(state.by_user(stream, processor), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert len(found) == len(hot[1])
    return {r["transaction_id"]: tuple(r)[1:] for r in found}


def test_profiles(spark, hot, tmp_path):
    got, seen = through(spark, hot, tmp_path, state.Profiles(block=7, fan=3)), {}
    for i, user, _, amount, _ in hot[1]:
        n, total = seen.get(user, (0, 0.0))
        assert got[i] == (n, pytest.approx(total))
        seen[user] = (n + 1, total + amount)


def test_risk(spark, hot, tmp_path):
    got, seen = through(spark, hot, tmp_path, state.AlertRisk(block=7, fan=3)), {}
    for i, user, _, _, severity in hot[1]:
        n, high = seen.get(user, (0, False))
        after = high or severity == "CRITICAL" or (severity == "HIGH" and n + 1 >= 3) or n + 1 >= 10
        assert got[i] == (n + 1, "high" if high else "medium", "high" if after else "medium")
        seen[user] = (n + 1, after)


def test_recent_lists(spark, hot, tmp_path):
    got, seen = through(spark, hot, tmp_path, state.RecentAlerts(block=7, fan=3)), {}
    for i, user, ts, _, _ in hot[1]:
        last, listed = seen.get(user, (ts, []))
        listed = [i, *(listed if ts - last <= timedelta(minutes=30) else [])][:10]
        assert got[i] == (",".join(map(str, listed)), len(listed))
        seen[user] = (ts, listed)
