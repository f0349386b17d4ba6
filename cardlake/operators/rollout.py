"""Ramp of a new model beside the one in use: a log of stages, shares by hash, both scores of every row, a gate after each stage, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.operators import evaluation, experiments
from cardlake.sources.versions import Table

STAGES = "stage int, share double, result string, rows long, agreement double, mean_difference double"
#: Shares of traffic that the new model serves, stage by stage.
SHARES = (0.05, 0.25, 1.0)


def share_now(table: Table, shares: tuple[float, ...] = SHARES) -> tuple[int, float]:
    """The stage to come and its share: the one after the last that passed; after a failed gate share 0, whatever follows. Stages are few: one a gate."""
    done = {r["stage"]: r["result"] for r in table.read().collect()}
    if "failed" in done.values():
        return max(done) + 1, 0.0
    return len(done), shares[min(len(done), len(shares) - 1)]


def served(rows: DataFrame, key: str, salt: str, share: float, old: str, new: str) -> DataFrame:
    """rows with is_new and score: the share of keys with the lowest hash gets the new score, so a key once in stays in as the share grows. Both scores stay for the log; a missing new score falls back to the old one."""
    is_new = (experiments.bucket(F.col(key), salt) <= round(share * 10_000)) & F.col(new).isNotNull() if share > 0 else F.lit(False)
    return rows.withColumn("is_new", is_new).withColumn("score", F.when(F.col("is_new"), F.col(new)).otherwise(F.col(old)))


def gate(log: DataFrame, old: str, new: str, least_rows: int, least_agreement: float, most_difference: float) -> DataFrame:
    """One row: rows, agreement and mean difference of both scores in the log, and whether the stage passes; an empty or small log fails."""
    c = evaluation.comparison(log.filter(F.col(new).isNotNull()), old, new).crossJoin(log.agg(F.count(new).alias("rows")))  # one row each
    good: Column = (F.col("rows") >= least_rows) & (F.col("agreement") >= least_agreement) & (F.col("mean_difference") <= most_difference)
    return c.select("rows", "agreement", "mean_difference", F.when(F.coalesce(good, F.lit(False)), "passed").otherwise("failed").alias("result"))


def stage(table: Table, rows: DataFrame, key: str, salt: str, old: str, new: str, least_rows: int = 100, least_agreement: float = 0.9, most_difference: float = 0.1, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """One stage over rows: the log (rows with is_new, score, stage, share), and its gate's result as the table's next version. After a failed gate rows are served by the old model and no gate is held."""
    number, share = share_now(table, shares)
    log = served(rows, key, salt, share, old, new).withColumns({"stage": F.lit(number), "share": F.lit(share)})
    if share > 0:
        made = gate(log, old, new, least_rows, least_agreement, most_difference)
        table.append(made.select(F.lit(number).alias("stage"), F.lit(share).alias("share"), "result", "rows", "agreement", "mean_difference"), number)
    return log
