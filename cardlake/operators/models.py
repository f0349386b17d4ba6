"""Fraud models of MLlib: features, folds, parameter search, scoring, weighted refits and the gate before a new model is used."""

from __future__ import annotations

from functools import reduce
from statistics import fmean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.operators.evaluation import ranked
from cardlake.sources.records import stored


def aligned(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """The features in a model's order as doubles; one that df lacks, or that is null or no number, is 0."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({f"f_{c}": clean(c) if c in df.columns else F.lit(0.0) for c in features})


def clipped(p: Column) -> Column:
    """A probability: what is no number or infinite is 0, the rest is brought to 0 to 1. Null stays null."""
    return F.when(F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))


def estimator(features: tuple[str, ...], categories: tuple[str, ...], model) -> Pipeline:
    """Categories by frequency, new ones last; then the vector and the model."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"i_{c}" for c in categories], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[f"f_{c}" for c in features] + [f"i_{c}" for c in categories], outputCol="features")
    return Pipeline(stages=[index, vector, model])


def logistic() -> LogisticRegression:
    return LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=20)


def trees(seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=5, seed=seed, maxBins=32)


def folded(df: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """df with fold: each label's rows, in order of the key's hash, are dealt in turn, so folds differ by one row of a label at most."""
    return ranked(df, key, label).withColumn("fold", F.pmod("_rank", F.lit(folds)).cast("int")).drop("_rank", "_all")


def validated(df: DataFrame, pipeline: Pipeline, grid: list[dict], folds: int = 5) -> list[tuple[float, float]]:
    """Mean and deviation, over df's folds (column fold), of each trial's AUC on the fold that it was not fit on.

    df is written once, and folds are read from there one after the other: a fit keeps the rows of one trial only, and no fold computes df anew.
    """
    held = stored(df, "folds")
    found = {r["fold"] for r in held.select("fold").distinct().limit(folds + 1).collect()}
    if found != set(range(folds)):
        raise ValueError(f"folds 0 to {folds - 1} must all have rows, and no other; found {found}")
    area = BinaryClassificationEvaluator(labelCol="label")
    of = lambda trial, i: area.evaluate(pipeline.fit(held.filter(F.col("fold") != i), trial).transform(held.filter(F.col("fold") == i)))
    told = [[of(trial, i) for i in range(folds)] for trial in grid]
    return [(fmean(t), pstdev(t)) for t in told]


def searched(df: DataFrame, pipeline: Pipeline, grid: list[dict], folds: int = 5) -> tuple[PipelineModel, list[tuple[float, float]]]:
    """The model of the parameters with the best mean AUC, fit on all of df (column fold), and each trial's mean and deviation."""
    trials = validated(df, pipeline, grid, folds)
    return pipeline.fit(df, grid[max(range(len(grid)), key=lambda i: trials[i][0])]), trials


def grid_of(model, **values: tuple) -> list[dict]:
    return reduce(lambda g, kv: g.addGrid(model.getParam(kv[0]), list(kv[1])), values.items(), ParamGridBuilder()).build()


def score(df: DataFrame, model: PipelineModel | None, fallback: Column, name: str = "score") -> DataFrame:
    """df with the model's probability of fraud, clipped to 0 to 1; the fallback where there is no model or its result is no number."""
    if model is None:
        return df.withColumn(name, fallback)
    p = vector_to_array("probability")[1]
    made = F.when(F.isnan(p) | p.isNull(), fallback).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
    return model.transform(df).withColumn(name, made).drop("rawPrediction", "probability", "prediction", "features")


def refit(pipeline: Pipeline, history: DataFrame, feedback: DataFrame) -> PipelineModel:
    """A new model from history and feedback together, each row by its weight."""
    return pipeline.fit(history.unionByName(feedback, allowMissingColumns=True))


def gate(df: DataFrame, old: str, new: str, auc: DataFrame, least_rows: int = 50) -> DataFrame:
    """One row: whether the new scores may replace the old ones. auc: one row, column auc, of the new scores."""
    one = df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.col(new).between(0, 1) & ~F.isnan(new)), F.lit(True)).alias("valid"),
        F.avg(F.abs(F.col(new) - F.col(old))).alias("mean_change"),
    ).crossJoin(F.broadcast(auc))  # one row each
    good = (F.col("n") <= least_rows) | (F.col("auc") >= 0.6)
    return one.withColumns({"accepted": F.col("valid") & good & (F.col("mean_change") <= 0.5), "warned": (F.col("n") > least_rows) & (F.col("auc") < 0.7)})
