"""Cross-validation against MLlib's own, on rows that are computed once."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from cardlake.operators import models


def test_folds_compute_their_rows_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(x: int) -> float:
        computed.add(1)
        return float(x * 7919 % 101)

    df = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("double").alias("label"), F.lit(1.0).alias("weight"), F.when(F.col("id") % 5 > 1, "x").otherwise("y").alias("c"))
    plain = df.withColumn("f_a", (F.col("id") * 7919 % 101).cast("double") + 20 * F.col("label"))
    counted = df.withColumn("f_a", F.udf(seen, "double")("id") + 20 * F.col("label"))
    pipeline = models.estimator(("a",), ("c",), models.logistic())
    (trial,) = models.validated(models.folded(counted, "id", "label", 3), pipeline, [{}], 3)
    assert computed.value <= 2 * 300  # the folds' sizes and the rows themselves, not once more a fold
    own = CrossValidator(estimator=pipeline, estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=3, foldCol="fold").fit(models.folded(plain, "id", "label", 3))
    assert trial == pytest.approx((own.avgMetrics[0], own.stdMetrics[0]), abs=1e-9) and 0.5 < trial[0] < 1


def test_each_fold_needs_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (1, 1.0)], "fold int, label double")
    with pytest.raises(ValueError):
        models.validated(df, models.estimator((), (), models.logistic()), [{}], 3)
