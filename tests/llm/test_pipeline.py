"""Each stage of the pipeline on its own input, and the operators behind them, against plain Python over whole tables."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardlake.llm import langid, pseudonyms, quality

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that each stage gets, and what it makes of them, with a fixed secret."""
    before = spark.conf.get(pseudonyms.SECRET, None)
    spark.conf.set(pseudonyms.SECRET, "a fixed secret")
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        path = str(tmp_path_factory.mktemp("stage") / name)
        made.write.parquet(path)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(path).collect()])
        docs = spark.read.parquet(path)
    yield out
    spark.conf.set(pseudonyms.SECRET, before) if before else spark.conf.unset(pseudonyms.SECRET)


def voted(text):
    """The votes of the rules in their order, and whether the base checks fail."""
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    repeats = len({i + k for i in range(len(ws) - 7) if runs[tuple(ws[i : i + 8])] > 1 for k in range(8)})
    n, chars = max(len(ws), 1), max(sum(map(len, ws)), 1)
    symbols, shouts = (len(re.findall(p, text or "")) for p in (r"[#*$%&|<>]", "!"))
    capitals = sum(c.isupper() for c in (text or ""))
    variety, odd = len(set(ws)) / math.sqrt(n), (symbols + shouts) / n
    bad = lambda c: -1 if c else 0
    votes = (
        bad(symbols > 0.25 * n), bad(capitals > 0.4 * chars), bad(shouts > 0.25 * n), -1 if odd > 0.3 else int(odd < 0.05 and capitals < 0.2 * chars), bad(repeats > 0.3 * n),
        bad(len(lines) >= 3 and len(lines) - len(set(lines)) > 0.3 * len(lines)), -1 if n >= 40 and variety < 2 else int(n >= 40 and variety > 4), -1 if n < 20 else int(n >= 40),
    )
    return votes, len(ws) < 20 or 100 * repeats > 30 * len(ws)


def learned(votes, rounds=60):
    """EM document by document: each one's chance of being good, with arrays of documents and rules."""
    v = np.array(votes) + 1
    held = quality.ANCHOR * len(v) + 1
    prior, good, bad = 0.9, np.tile(quality.START["good"], (v.shape[1], 1)), np.tile(quality.START["bad"], (v.shape[1], 1))
    rule = np.arange(v.shape[1])

    def chance():
        x = math.log(prior / (1 - prior)) + (np.log(good[rule, v]) - np.log(bad[rule, v])).sum(axis=1)
        return 1 / (1 + np.exp(-x))

    for _ in range(rounds):
        p = chance()
        new = []
        for mass, share, start in ((p, 0.9, quality.START["good"]), (1 - p, 0.1, quality.START["bad"])):
            counts = np.stack([[(mass * (v[:, r] == k)).sum() for k in range(3)] for r in rule])
            new.append((counts + held * share * np.array(start)) / (mass.sum() + held * share))
        prior, good, bad = (p.sum() + 0.9 * held) / (len(v) + held), *new
    return chance()


def test_quality_stage(spark, stages):
    docs, kept = stages["quality"]
    found = [voted(d["text"]) for d in docs]
    chances = learned([v for v, _ in found])
    assert sorted(d["doc_id"] for d in kept) == sorted(d["doc_id"] for d, (_, failed), p in zip(docs, found, chances, strict=True) if not failed and p >= 0.5)
    measured = quality.features(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r["quality"] for r in quality.judge(measured, quality.fit(measured)).collect()}
    assert [got[d["doc_id"]] for d in docs] == pytest.approx(chances.tolist(), abs=1e-9)


def test_decontamination_stage(spark, stages):
    docs, kept = stages["decontamination"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = word.findall((b["text"] or "").translate(LOW))
        windows |= {tuple(ws[i : i + 13]) for i in range(max(1, len(ws) - 12) if ws else 0)}
    clean = []
    for d in docs:
        ws, hit = word.findall((d["text"] or "").translate(LOW)), set()
        for size in {len(w) for w in windows}:
            hit |= {i + k for i in range(len(ws) - size + 1) if tuple(ws[i : i + size]) in windows for k in range(size)}
        if not (hit and 20 * len(hit) >= len(ws)):
            clean.append(d["doc_id"])
    assert sorted(d["doc_id"] for d in kept) == sorted(clean) and len(clean) < len(docs)


def test_pseudonym_stage(spark, stages):
    docs, made = stages["pseudonyms"]
    after = {d["doc_id"]: d for d in made}
    assert len(after) == len(docs) == len(made)
    changed = [d for d in docs if after[d["doc_id"]]["text"] != d["text"]]
    assert changed and all(re.search(r"[\d@]", d["text"]) for d in changed)
    assert all({k: v for k, v in after[d["doc_id"]].items() if k != "text"} == {k: v for k, v in d.items() if k != "text"} for d in docs)
    again = corpus_pipeline.pseudonymous(spark, spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string"), SF)
    assert {r["doc_id"]: r["text"] for r in again.collect()} == {k: d["text"] for k, d in after.items()}


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, pieces = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {d["doc_id"]: [*t.encode(d["text"], add_special_tokens=False).ids, 0] for d in docs}
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = np.frombuffer(bytes(p["token_ids"]), "<u4").tolist()
        assert len(own) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        of_doc[p["doc_id"]].append((p["start"], own))
        of_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in of_doc.items()} == ids
    for parts in of_sequence.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_language_by_definition(spark):
    """Prototypes and predictions of whole texts from single bound vectors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text", "lang")
    rows = [r.asDict() for r in docs.collect()] + [{"doc_id": -1, "text": None, "lang": "en"}, {"doc_id": -2, "text": "42 !", "lang": None}]
    letters = langid.Letters(64, 5)
    vectors = {}

    def vector(c):
        return vectors.setdefault(c, letters._vector(ord(c)) if c else letters.vectors[0])

    def bundle(text):
        signs = [""]
        for c in text.lower():
            c = c if c.isalpha() else ""
            if c or signs[-1]:
                signs.append(c)
        signs += [""] if signs[-1] else []
        grams = collections.Counter((a, b, c) for a, b, c in zip(signs, signs[1:], signs[2:]) if b)
        return sum((n * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for (a, b, c), n in grams.items()), np.zeros(64))

    table = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    prototypes = langid.learn(table, 64, 5)
    want = {}
    for r in rows:
        if r["text"] and r["lang"]:
            want[r["lang"]] = want.get(r["lang"], 0) + bundle(r["text"])
    assert prototypes.keys() == want.keys() and all(np.array_equal(prototypes[k], want[k]) for k in want)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(table.drop("lang"), prototypes, 5).collect()}
    for r in rows:
        v = bundle(r["text"] or "")
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in sorted(want.items())} if v.any() else {}
        best = max(cosines, key=lambda k: cosines[k]) if cosines else "und"
        assert got[r["doc_id"]] == (best, pytest.approx(max(0.0, cosines.get(best, 0.0)), abs=1e-5))


def test_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).isEmpty()
    odd = docs.sparkSession.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    assert odd.count() == sum(1 for _ in corpus_pipeline.good_documents(spark, odd, SF).collect()) + 3
    assert corpus_pipeline.packed(spark, odd, SF).agg(F.sum("length")).first()[0] == 3
