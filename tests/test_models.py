"""Models against plain checks of their results."""

import pytest
from pyspark.sql import functions as F

from cardlake.operators import evaluation, models
from cardlake.plans import learning

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["preprocessing_pipeline", "batch_scoring", "update_gate", "shadow_comparison"])
def test_runs(spark, name):
    assert getattr(learning, name)(spark, DIR).count() > 0


def test_vectors_are_aligned(spark):
    out = models.aligned(spark.createDataFrame([(1.0, None, "x"), (float("nan"), 2.0, " 3.5")], "a double, b double, d string"), ("a", "b", "c", "d")).collect()
    assert [(r.f_a, r.f_b, r.f_c, r.f_d) for r in out] == [(1.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, 3.5)]


def test_folds_and_search(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"), F.lit("x").alias("c"), (F.col("id") % 2 + F.rand(1)).alias("a"))
    r = models.folded(models.aligned(df, ("a",)), "id", "label", 3)
    assert {(x.fold, x.label, x["count"]) for x in r.groupBy("fold", "label").count().collect()} == {(f, y, 100) for f in range(3) for y in (0.0, 1.0)}
    m = models.trees()
    best, trials = models.searched(r, models.estimator(("a",), ("c",), m), models.grid_of(m, maxDepth=(1, 2)), 3)
    assert len(trials) == 2 and min(t[0] for t in trials) > 0.9
    scored = models.score(r, best, F.lit(0.0))
    assert scored.filter("score between 0 and 1").count() == 600


def test_auc_is_the_share_of_ordered_pairs(spark):
    data = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.2, 0), (0.05, 1)]
    pairs = [(a > b) + (a == b) / 2 for a, y in data if y for b, z in data if not z]
    got = evaluation.auc(spark.createDataFrame(data, "s double, y int"), "s", "y").first()[0]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_fallback_and_gate(spark):
    df = spark.createDataFrame([(0.2, 0.3), (0.9, 0.1)], "old double, new double")
    assert [r.score for r in models.score(df, None, F.lit(0.5)).collect()] == [0.5, 0.5]
    auc = spark.createDataFrame([(0.9,)], "auc double")
    assert models.gate(df, "old", "new", auc).first()["accepted"]
    assert not models.gate(df.withColumn("new", F.lit(1.5)), "old", "new", auc).first()["accepted"]
