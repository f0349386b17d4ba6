"""The toxicity machine against its definition: training in blocks, worst tokens, margins and scores of whole texts."""

import math
from itertools import combinations

import numpy as np
import pytest

from cardlake.llm import toxicity as tx


def margin(word, weights, bias):
    """By every triple of places."""
    signs = [0, *(ord(c) - 95 if "a" <= c <= "z" else 28 + ord(c) % 36 for c in word), 1]
    counts = {}
    for i, j, k in combinations(range(len(signs)), 3):
        code = (signs[i] * tx.SIGNS + signs[j]) * tx.SIGNS + signs[k]
        counts[code] = counts.get(code, 0) + tx.DECAY ** (k - i + 1)
    norm = math.sqrt(sum(v * v for v in counts.values()))
    return sum(v * weights[c] for c, v in counts.items()) / norm + bias


def test_scores_of_texts_by_definition(spark):
    r = np.random.default_rng(2)
    model = tx.Model(r.normal(size=tx.SIGNS**3), -0.3, (2.0, 1.0, 0.5, -0.7))
    texts = ["plain words here", "v.i.l.e stuff", "a b c d", "", None, "42 !!", "été ñandú 日本", "x" * 40 + " tail", "same same same", "Mixed CASE mixed"]
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t in enumerate(texts)], "doc_id long, text string, score double, _x int")
    got = {x["doc_id"]: x["score"] for x in tx.score(docs, model).collect()}
    for i, t in enumerate(texts):
        found = []
        for token in tx.tokens(t):
            f = tx.form(token)
            found.append(min(2, max([margin(p, model.weights, model.bias) for p in tx.parts(f)], default=-2.0)) if f else -2.0)
        a, b, c = sorted([-1.0, -1.0, -1.0, *[max(x, -2) for x in found]], reverse=True)[:3]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(2 * a + b + 0.5 * c - 0.7))))


def test_machine_in_blocks_is_the_machine():
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * r.normal(size=90) > 0.4, 1.0, -1.0)
    share = r.random(90) / 90
    w = tx.squared_hinge(x, y, share, block=7)
    assert w == pytest.approx(tx.squared_hinge(x, y, share), abs=1e-7)
    ones = np.hstack([x.astype(float), np.ones((90, 1))])
    slack = np.maximum(0, 1 - y * (ones @ w))
    gradient = np.append(np.full(6, tx.RIDGE), 1e-9) * w - (share * y * slack) @ ones  # of ridge / 2 + share slack² / 2
    assert np.abs(gradient).max() < 1e-8


def test_worst_tokens_of_bags(spark):
    r = np.random.default_rng(4)
    weights, words = r.normal(size=tx.SIGNS**3), ["ab", "cde", "fghi", "zz", "éa"]
    bags = [(int(i % 2), sorted(set(r.choice(words, 1 + i % 4)))) for i in range(60)]
    want = {}
    for y, ws in bags:
        best = max(ws, key=lambda w: (round(margin(w, weights, 0.1), 12), -ws.index(w)))
        want[y, best] = want.get((y, best), 0) + 1
    bad, good = tx._worst_tokens(spark.createDataFrame(bags, "toxic long, parts array<string>"), weights, 0.1)
    assert {(1, k): v for k, v in bad.items()} | {(0, k): v for k, v in good.items()} == want


def test_no_labels_and_a_very_long_token(spark):
    assert tx.learn(spark.createDataFrame([], "doc_id long, text string, toxic int")).weights is None
    one = spark.createDataFrame([(1, "only clean", 0)], "doc_id long, text string, toxic int")
    assert tx.learn(one).weights is None
    assert [x["score"] for x in tx.score(one, tx.Model()).collect()] == [0.0]
    model = tx.Model(np.zeros(tx.SIGNS**3), 0.2, (1.0, 0.0, 0.0, 0.0))
    long = spark.createDataFrame([(1, "qx" * 20_000)], "doc_id long, text string")
    assert tx.score(long, model).first()["score"] == pytest.approx(1 / (1 + math.exp(-0.2)))
