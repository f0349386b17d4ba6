"""Parameter search: seeded draws from a space, successive halving over folds, and a table of trials that a restarted search goes on from.

A trial's draw depends on the seed, the trial's number and the parameter's name only, so it is the same however many trials there are and whenever they run. Rung k scores the trials that are left on
fold k; then those with the best mean so far stay, the larger half. Scores are appended as they come to a versioned table, one commit for each trial and fold; a score that is there already is neither
computed nor added again.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.operators import models
from cardlake.sources.versions import Table

TRIALS = "seed long, trial int, fold int, score double, parameters string"
Params = dict[str, float]


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def of(self, u: float) -> float:
        return self.low + (self.high - self.low) * u


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def of(self, u: float) -> float:
        return math.exp(math.log(self.low) + (math.log(self.high) - math.log(self.low)) * u)


@dataclass(frozen=True)
class Whole:
    low: int
    high: int
    step: int = 1

    def of(self, u: float) -> int:
        return self.low + self.step * min(int(u * ((self.high - self.low) // self.step + 1)), (self.high - self.low) // self.step)


Space = dict[str, Uniform | LogUniform | Whole]

#: The ranges searched for boosted trees, by the names that MLlib has for the parameters. Penalties on leaf weights have no such name.
BOOSTED: Space = {"maxIter": Whole(100, 3000, 50), "maxDepth": Whole(3, 20), "stepSize": LogUniform(0.01, 0.3), "subsamplingRate": Uniform(0.6, 1.0), "featureShare": Uniform(0.6, 1.0), "minInstancesPerNode": Whole(1, 10)}


def uniform(seed: int, trial: int, name: str) -> float:
    """A number from 0 to 1 (exclusive), from 48 bits of a hash."""
    return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:12], 16) / (1 << 48)


def drawn(space: Space, seed: int, trial: int) -> Params:
    return {name: kind.of(uniform(seed, trial, name)) for name, kind in space.items()}


def halving(table: Table, space: Space, trials: int, folds: int, seed: int, score: Callable[[dict[int, Params], int], dict[int, float]], one_by_one: bool = True) -> list[int]:
    """Runs the rungs that the table lacks and returns the trials left after the last one. score: trials with parameters and a fold to scores; NaN for a trial that failed, which is the worst.

    one_by_one: each trial is scored and committed by itself; else a rung's missing trials are scored together, in one pass over the data.
    """
    known = {(r["trial"], r["fold"]): r["score"] for r in table.read().filter(F.col("seed") == seed).collect()}
    left = list(range(trials))
    for fold in range(folds):
        missing = [t for t in left if (t, fold) not in known]
        for some in ([[t] for t in missing] if one_by_one else [missing] if missing else []):
            made = score({t: drawn(space, seed, t) for t in some}, fold)
            rows = [(seed, t, fold, float(s), json.dumps(drawn(space, seed, t))) for t, s in sorted(made.items())]
            table.append(table.spark.createDataFrame(rows, TRIALS), f"{seed}:{fold}:{','.join(map(str, some))}")
            known |= {(t, fold): float(s) for t, s in made.items()}
        mean = {t: sum(known[t, f] for f in range(fold + 1)) / (fold + 1) for t in left}
        left = sorted(sorted(left, key=lambda t: (-mean[t] if mean[t] == mean[t] else math.inf, t))[: -(-len(left) // 2)]) if fold < folds - 1 else left
    return left


def ranks(table: DataFrame, folds: int) -> DataFrame:
    """trial, parameters, rungs (folds the trial was scored on), score (mean), rank: trials of more rungs first, then by score; equal ones by number. One row a trial, of which there are as many as were asked for."""
    from pyspark.sql.window import Window

    by = table.groupBy("seed", "trial").agg(F.first("parameters").alias("parameters"), F.count("*").alias("rungs"), F.avg("score").alias("score"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("rungs"), F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), "trial")))


def boosted_score(rows: DataFrame, features: tuple[str, ...], categories: tuple[str, ...], seed: int = 42) -> Callable[[dict[int, Params], int], dict[int, float]]:
    """Scores trials of BOOSTED or a part of it: AUC of trees fit on the rows (stored, with fold, label, weight) of all folds but one, on that one. A trial whose training fails scores NaN."""

    def score(trials: dict[int, Params], fold: int) -> dict[int, float]:
        from pyspark.errors import PySparkException

        out = {}
        for trial, p in trials.items():
            model = models.trees(seed)
            share = p.get("featureShare")
            model.setParams(**{k: v for k, v in p.items() if k != "featureShare"}, **({"featureSubsetStrategy": f"{share:.4f}"} if share else {}))
            try:
                fit = models.estimator(features, categories, model).fit(rows.filter(F.col("fold") != fold))
                out[trial] = BinaryClassificationEvaluator(labelCol="label").evaluate(fit.transform(rows.filter(F.col("fold") == fold)))
            except PySparkException:
                out[trial] = float("nan")
        return out

    return score


def weighted_rules(p: Params, flags: tuple[str, ...]) -> Column:
    """Whether the weights of the flags that hold add up to the limit."""
    total = sum((F.lit(p[f]) * F.col(f).cast("int") for f in flags), F.lit(0.0))
    return F.round(total, 9) >= F.lit(round(p["limit"], 9))


def rules_score(rows: DataFrame, flags: tuple[str, ...]) -> Callable[[dict[int, Params], int], dict[int, float]]:
    """Scores all trials of a rung in one pass: F1 of the weighted rules on a fold's rows (fold, label and boolean flags), from counts by flags."""
    counts = rows.groupBy("fold", *flags).agg(F.count("*").alias("n"), F.sum("label").alias("p"))

    def score(trials: dict[int, Params], fold: int) -> dict[int, float]:
        said = {t: weighted_rules(p, flags) for t, p in trials.items()}
        hit = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
        one = counts.filter(F.col("fold") == fold).agg(*[(2 * hit(c, "p") / F.greatest(hit(c, "n") + hit(F.lit(True), "p"), F.lit(1))).alias(str(t)) for t, c in said.items()]).first()
        return {t: float(one[str(t)]) for t in trials}

    return score


def new_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, TRIALS)
