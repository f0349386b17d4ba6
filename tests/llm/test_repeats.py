"""Removal of repeated byte strings against all strings in a dictionary."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, r string")
    found = repeats.remove_repeats(docs, **how)
    assert sorted(found.columns) == sorted(["doc_id", "text", "r", *repeats.RESULTS]) and not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    got = {r["doc_id"]: tuple(r[c] for c in repeats.RESULTS) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, how.get("length", repeats.LENGTH))


def test_columns_against_sorting():
    dice = random.Random(5)
    for _ in range(60):
        length = dice.randrange(2, 9)
        strings = ["".join(dice.choices("abc"[: dice.randrange(1, 4)], k=dice.randrange(length, 30))).encode() for _ in range(dice.randrange(1, 20))]
        starts = np.array([dice.randrange(1, len(s) - length + 2) for s in strings])
        seen = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[seen[s[i : i + length]] > 1 for i in range(n)] for s, n in zip(strings, starts, strict=True)]
        assert [x.tolist() for x in repeats.shared_starts(strings, starts, length)] == want


@pytest.mark.parametrize(("window", "limit"), [(16, 1000), (16, 2), (5, 3)])
def test_planted_strings(spark, window, limit):
    """A passage in many texts that go on in different ways, near and exact copies, runs of a byte, other scripts; small limits halve groups down to single starts."""
    dice = random.Random(9)
    word = lambda: "".join(dice.choices("abcdé日", k=dice.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(14), text(120)
    texts = [f"{text(dice.randrange(9))} {passage} {text(dice.randrange(9))}" for _ in range(60)]
    texts += [base, base, base[:200] + "X" + base[201:], base[50:90], base[50:89] + "q", "a" * 400, "a" * 300, text(3), "", None, "x" * 30 + "y" * 30 + "x" * 30]
    check(spark, texts, length=30, window=window, limit=limit)


def test_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    texts = [r["text"] for r in docs.collect()]
    check(spark, [*texts, texts[0][100:900], "z" * 2000, "lorem ipsum dolor sit amet " * 4000])


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    data = ("ab" * 300 + "cdefghij" * 90).encode()
    texts = spark.createDataFrame([(b"r", 1, data), (b"s", 1, data[37:]), (b"t", 1, b"z" * 41)], "r binary, m long, text binary")
    runs = repeats.repeated(texts, 40, 9).groupBy("r").agg(F.min("first"), F.max("past")).collect()
    assert {bytes(r[0]): (r[1], r[2]) for r in runs} == {b"r": (0, len(data) - 39), b"s": (0, len(data) - 37 - 39), b"t": (0, 2)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).isEmpty()
