"""Tails, quantiles, running sums, drift rows and alerts told, against plain Python."""

import collections
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.operators import alerts, drift, evaluation, features, profiles, stats
from cardlake.operators.quantiles import quantiles, running_sum
from cardlake.plans import learning, reports
from cardlake.sources import contracts, records

DIR = "/root/testdata/sf0.001"


def test_tails(spark):
    zs = [0.0, 0.5, 1.96, 4.0, -1.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=1e-6)
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_tail(2 * 7.5, 2) == pytest.approx(math.exp(-7.5), rel=1e-12)
    assert stats.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_tail(1.0, 1) == pytest.approx(0.5, abs=1e-8)
    d = spark.range(1).select(stats.ks_p(F.lit(1.3581 / 10), F.lit(200.0), F.lit(200.0)).alias("p")).first().p
    assert d == pytest.approx(0.05, abs=1e-3)


@pytest.mark.parametrize("few", [10_000, 4])
def test_quantiles(spark, few):
    r = np.random.default_rng(1)
    rows = [(k % 3 if k % 10 else None, float(v), ) for k, v in enumerate(np.round(r.exponential(5, 500), 1))] + [(7, 2.5), (0, None)]
    got = {x["k"]: (x["a"], x["b"], x["c"]) for x in quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.99}, few).collect()}
    for k in (0, 1, 2, None, 7):
        assert got[k] == pytest.approx(tuple(np.quantile([v for q, v in rows if q == k and v is not None], [0, 0.37, 0.99])))
    assert quantiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", {"a": 0.5}).isEmpty()


def test_running_sum(spark):
    rows = [(k % 2 if k % 5 else None, k // 3, k, k) for k in range(60)]
    df = spark.createDataFrame(rows, "key int, ts int, transaction_id int, v int")
    got = {x.transaction_id: x.s for x in running_sum(df, ["key"], F.col("v"), "s").collect()}
    assert got == {i: sum(v for q, t, j, v in rows if q == key and (t, j) <= (ts, i)) for key, ts, i, _ in rows}


def test_alerts_told_again_after_an_hour(spark):
    r = np.random.default_rng(2)
    rows, at = [], 0
    for i in range(300):
        at += int(r.integers(1, 3000))
        rows.append((i, int(r.integers(0, 2)), "LOW", at))
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, severity string, s long").withColumn("ts", F.timestamp_seconds("s"))
    last, want = {}, set()
    for i, u, _, s in rows:
        if u not in last or s - last[u] > 3600:
            want.add(i)
            last[u] = s
    assert {x.transaction_id for x in alerts.told(df).collect()} == want


def test_chi_square_with_correction(spark):
    rows = [("a", True)] * 10 + [("b", True)] * 20 + [("a", False)] * 30 + [("b", False)] * 5
    x = drift.chi_square(spark.createDataFrame(rows, "c string, is_reference boolean"), "c").first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((10, 30 * 40 / 65), (20, 30 * 25 / 65), (30, 35 * 40 / 65), (5, 35 * 25 / 65)))
    assert (x.statistic, x.categories) == (pytest.approx(want), 2)


def test_drift_rows(spark):
    out = reports.drift_table(spark, DIR).collect()
    assert collections.Counter(r.test for r in out) == {"psi": 5, "kolmogorov_smirnov": 3, "chi_square": 2, "jensen_shannon": 2, "two_proportions": 1, "head_and_tail": 1}
    assert all(0 <= r.confidence <= 1 and r.severity in ("low", "medium", "high", "critical") and len(r.advice) == 2 for r in out)
    assert all(0 <= r.p <= 1 for r in reports.chi_square_test(spark, DIR).collect())
    assert all(0 <= r.p <= 1 for r in reports.performance_drift_test(spark, DIR).collect())


def test_common_features():
    assert drift.common_features(("a", "b", "c", "d", "e"), ("e", "d", "c", "b", "z")) == ["b", "c", "d", "e"]
    with pytest.raises(ValueError):
        drift.common_features(("a", "b", "c"), ("a", "b"))


def test_codes_of_categories(spark):
    out = reports.hash_encode_category(spark, DIR).collect()
    assert all(0 <= r.product_code < 1000 for r in out) and len({(r.product, r.product_code) for r in out}) == len({r["product"] for r in out})
    assert len({r.email_code for r in out if r.p_email is None}) == 1


def test_broken_messages(spark):
    rows = [("t", "1", '{"transaction_id": 1, "user_id": 2, "ts": "2024-01-01T00:00:00", "amount": 3.5, "product": "view"}'), ("t", "1", '{"transaction_id": 1, "product": "zebra"}'), ("t", "1", "no json"), ("t", None, None)]
    out = [r.errors for r in contracts.decoded(spark.createDataFrame(rows, "topic string, key string, value string"), contracts.TRANSACTION).collect()]
    assert out[0] == [] and out[1] == ["missing_user_id", "missing_ts", "missing_amount", "unknown_product"]
    assert all(e[:2] == ["missing_transaction_id", "missing_user_id"] for e in out[2:])


def test_model_queries(spark):
    (fold,) = learning.stratified_k_fold_auc(spark, DIR).collect()
    assert 0.5 < fold.auc <= 1 and fold.deviation >= 0
    trials = learning.parameter_search(spark, DIR).collect()
    assert sorted(t.rungs for t in trials) == [1] * 4 + [2] * 2 + [3] * 2 and sorted(t["rank"] for t in trials) == list(range(1, 9)) and all(0 <= t.score <= 1 for t in trials)
    new = learning.weighted_update_from_feedback(spark, DIR).collect()
    assert all(0 <= r.old <= 1 and 0 <= r.new <= 1 for r in new) and any(r.old != r.new for r in new)


@pytest.mark.parametrize("few", [10_000, 4])
def test_exact_curves(spark, few):
    r = np.random.default_rng(3)
    rows = [(k % 2, float(s), int(r.random() < s)) for k, s in enumerate(np.round(r.random(400), 2) + r.integers(0, 3, 400) * 1e-5)] + [(0, None, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")

    def auc(kept):
        pos, neg = [s for s, y in kept if y], [s for s, y in kept if not y]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    scored = [(s, y) for _, s, y in rows if s is not None]
    assert evaluation.auc(df, "s", "y", few).first()[0] == pytest.approx(auc(scored))
    by = {x["g"]: x["auc"] for x in evaluation.auc_by(df, ["g"], "s", "y", few).collect()}
    assert by == {g: pytest.approx(auc([(s, y) for q, s, y in rows if q == g and s is not None])) for g in (0, 1)}
    cuts = sorted({s for s, _ in scored}, reverse=True)
    said = {c: [y for s, y in scored if s >= c] for c in cuts}
    positives = sum(y for _, y in scored)
    precision = sum(sum(y for s, y in scored if s == c) / positives * sum(said[c]) / len(said[c]) for c in cuts)
    assert evaluation.average_precision(df, "s", "y", few).first()[0] == pytest.approx(precision)
    recall = max((sum(said[c]) / positives for c in cuts if (len(said[c]) - sum(said[c])) / (len(scored) - positives) <= 0.1), default=0)
    assert evaluation.recall_at_fpr(df, "s", "y", 0.1, few).first()[0] == pytest.approx(recall)


@pytest.mark.parametrize("few", [10_000, 4])
def test_normal_distance(spark, few):
    r = np.random.default_rng(4)
    xs = sorted(np.round(r.normal(0.2, 1.1, 300), 2))
    law = [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs]
    d = max(max((i + 1) / 300 - p, p - i / 300) for i, p in enumerate(law))
    got = evaluation.normal_distance(spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double"), F.col("x"), few).first()
    assert got["n"] == 300 and got["d"] == pytest.approx(d, abs=1e-6) and 0 < got["p"] < 0.2


def test_rank_before_and_as_of(spark):
    r = np.random.default_rng(5)
    rows = [(i, 0 if i % 3 else int(r.integers(1, 9)), datetime(2024, 1, 1) + timedelta(minutes=int(r.integers(0, 200))), float(r.integers(0, 12)) if i % 11 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, ts timestamp, amount double")
    got = {x["transaction_id"]: (x["earlier"], x["smaller"]) for x in features.rank_before(df, "user_id", "amount").collect()}
    log = spark.createDataFrame([(u, t, i, i) for i, u, t, _ in rows], "user_id long, since timestamp, nth long, told long")
    upto = {x["transaction_id"]: x["told"] for x in features.as_of(df, log, "since", "told", ("user_id",), "nth").collect()}
    past = {x["transaction_id"]: x["told"] for x in features.as_of(df, log, "since", "told", ("user_id",), "nth", strict=True).collect()}
    for i, u, t, a in rows:
        before = [x for x in rows if x[1] == u and (x[2], x[0]) < (t, i)]
        assert got[i] == (len(before), sum(a is not None and x[3] is not None and x[3] < a for x in before))
        assert upto[i] == max(((x[2], x[0]) for x in rows if x[1] == u and x[2] <= t))[1]
        assert past[i] == max(((x[2], x[0]) for x in rows if x[1] == u and x[2] < t), default=(0, None))[1]


def test_join_of_bucketed_tables_has_no_exchange(spark):
    left, right = (records.bucketed(spark.range(1000).withColumn(c, F.col("id") % 7), c, "id", 4) for c in ("a", "b"))
    joined = left.join(right.hint("merge"), "id")
    assert joined.count() == 1000
    joined.collect()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tracked", [8192, 16])
def test_top_values_are_exact(spark, tracked):
    """With a sketch too small to settle the columns they are counted in full."""
    r = np.random.default_rng(8)
    rows = [(str(int(x)), "ab"[int(x) % 2] if x % 5 else None) for x in r.zipf(1.3, 3000) % 700]
    df = spark.createDataFrame(rows, "many string, few string")
    got = {(x["key"], x["value"]): (x["n"], x["rank"]) for x in profiles.top_values(df, ("many", "few"), 5, tracked, 64).collect()}
    for i, key in enumerate(("many", "few")):
        counts = sorted(collections.Counter(x[i] for x in rows if x[i] is not None).items(), key=lambda c: (-c[1], c[0]))[:5]
        assert {(k, v): n for (k, v), n in got.items() if k == key} == {(key, v): (n, j + 1) for j, (v, n) in enumerate(counts)}
