"""State by user with transformWithState: running profiles, alert risk, and the list of a user's recent alerts.

A user's rows of a trigger come in Arrow batches; they are put in order of time a batch at a time. One batch is sorted as it is. More batches become sorted runs whose blocks wait in map state (on
the executor's disk, by RocksDB), and are merged block by block, at most FAN runs at once; so memory is bounded however many of the trigger's rows a user has. State needs the RocksDB provider.
"""

from __future__ import annotations

import heapq
import itertools
import json
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardlake.streaming.live import LATE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a block in map state, and runs merged at once.
BLOCK, FAN = 2000, 64
DAY_MS = 86_400_000


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder:
    """Rows (time in microseconds, id, further numbers or texts) of one key in order of time and id, with blocks of sorted runs kept in map state."""

    def __init__(self, blocks, block: int = BLOCK, fan: int = FAN):
        self.blocks, self.block, self.fan = blocks, block, fan

    def _put(self, run: int, rows: Iterator[tuple]) -> int:
        n = 0
        while part := list(itertools.islice(rows, self.block)):
            self.blocks.updateValue((run, n), (json.dumps(part),))
            n += 1
        return n

    def _taken(self, run: int, n: int) -> Iterator[tuple]:
        for i in range(n):
            (text,) = self.blocks.getValue((run, i))
            self.blocks.removeKey((run, i))
            yield from map(tuple, json.loads(text))

    def of(self, frames: Iterator[list[tuple]]) -> Iterator[tuple]:
        place = operator.itemgetter(0, 1)
        first = sorted(next(frames, []), key=place)
        second = next(frames, None)
        if second is None:
            yield from first
            return
        runs: list[tuple[int, int]] = []
        number = 0
        for rows in itertools.chain([first, second], frames):
            runs.append((number, self._put(number, iter(sorted(rows, key=place)))))
            number += 1
            if len(runs) == self.fan:
                runs = [(number, self._put(number, heapq.merge(*[self._taken(*r) for r in runs], key=place)))]
                number += 1
        yield from heapq.merge(*[self._taken(*r) for r in runs], key=place)


class ByUser(StatefulProcessor):
    """A processor that sees a user's rows in order. Subclasses: state (name to schema), columns read, step (state value and row to new value and output row) and output columns."""

    columns: tuple[str, ...] = ()
    value_schema, start, outputs = "", (), ()
    idle_ms = 30 * DAY_MS

    def __init__(self, block: int = BLOCK, fan: int = FAN):
        self.block, self.fan = block, fan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.value_schema)
        self.blocks = handle.getMapState("blocks", "run int, block int", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def plain(frame: pd.DataFrame) -> list[tuple]:
            us = frame["us"].tolist()
            return list(zip(us, *(frame[c].tolist() for c in self.columns), strict=True))

        state = self.value.get() if self.value.exists() else self.start
        out, last = [], None
        for row in InOrder(self.blocks, self.block, self.fan).of(map(plain, rows)):
            state, made = self.step(tuple(state), row)
            out.append(made)
            last = row[0]
            if len(out) == self.block:
                yield pd.DataFrame(out, columns=list(self.outputs))
                out = []
        if last is not None:
            self.value.update(tuple(state))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=list(self.outputs))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Profiles(ByUser):
    """How many transactions a user had before each one, and their sum; forgotten after 30 days of event time without any."""

    columns, outputs = ("transaction_id", "amount"), ("transaction_id", "total_transactions", "total_amount")
    value_schema, start = "n long, total double", (0, 0.0)
    schema = "transaction_id long, total_transactions long, total_amount double"

    def step(self, state, row):
        (n, total), (_, key, amount) = state, row
        return (n + 1, total + (0.0 if amount != amount or amount is None else amount)), (key, n, total)


class AlertRisk(ByUser):
    """The number of the user's alerts so far and the risk before and after each; high stays. Forgotten after 90 days."""

    columns, outputs = ("transaction_id", "severity"), ("transaction_id", "nth", "risk_before", "risk_after")
    value_schema, start = "n long, high boolean", (0, False)
    schema = "transaction_id long, nth long, risk_before string, risk_after string"
    idle_ms = 90 * DAY_MS

    def step(self, state, row):
        (n, high), (_, key, severity) = state, row
        n += 1
        after = high or severity == "CRITICAL" or severity == "HIGH" and n >= 3 or n >= 10
        return (n, after), (key, n, "high" if high else "medium", "high" if after else "medium")


class RecentAlerts(ByUser):
    """With each alert the user's last `most` alerts, newest first; the list ends half an hour after the last of them (list state, ended by an event-time timer)."""

    columns, outputs = ("transaction_id",), ("transaction_id", "recent", "n_recent")
    value_schema, start = "last long", (0,)
    schema = "transaction_id long, recent string, n_recent int"
    idle_ms, most = 1_800_000, 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.listed = handle.getListState("listed", "transaction_id long")
        self.now: list[int] | None = None

    def handleInputRows(self, key, rows, timerValues):
        self.now = [x[0] for x in self.listed.get()] if self.listed.exists() else []
        yield from super().handleInputRows(key, rows, timerValues)
        self.listed.put([(x,) for x in self.now])

    def step(self, state, row):
        us, key = row
        if us - state[0] > self.idle_ms * 1000:
            self.now = []
        self.now = [key, *self.now][: self.most]
        return (us,), (key, ",".join(map(str, self.now)), len(self.now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.listed.clear()
        return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)


def by_user(stream: DataFrame, processor: ByUser) -> DataFrame:
    """stream (user_id, ts and the processor's columns) through a processor. Rows of one trigger are taken in order of time; a row later than the watermark is taken when it comes."""
    use_rocks(stream.sparkSession)
    rows = stream.withWatermark("ts", LATE).selectExpr("user_id", "ts", "unix_micros(ts) AS us", *processor.columns)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, processor.schema, "append", "EventTime")
