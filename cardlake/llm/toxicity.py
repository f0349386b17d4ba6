"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

Kernel: two strings (with a sign before and after) are alike as far as they share subsequences of three signs, each weighted by DECAY to the length it spans, normalised to 1. So gaps and
inserted characters lower the similarity of an insult to itself only a little. A token's form is its lower-cased letters, so signs put between
them vanish; runs of single letters count as one token as well. Long forms are compared by overlapping parts of LONGEST letters, the
worst of which counts: a subsequence over more than LONGEST / 2 + 1 letters (at most 1 % of a short one's weight) may be in no part. Letters other than a-z share SIGNS - 28 signs by code point.

A sentence is the set of its tokens. It is as toxic as its worst token, and a text as its worst sentence. Landmarks are tokens: half of them those that occur far more in toxic texts,
half the most frequent ones of clean texts, counted over all learned rows; they span the space that the machine works in, and a machine that tells the two halves apart is the start.
Then the machine is trained on the sentences of a hashed sample of learned rows (TOXIC_ROWS and CLEAN_ROWS of them in expectation), labelled as their text. As only some sentence of a toxic text need be
toxic, ROUNDS times the machine names each toxic text's worst sentence and its worst token, and each clean sentence's worst token, and a squared-hinge machine is trained on those (of toxic texts also in forms
with a letter inserted or doubled), clean ones of all rounds together. Worst tokens are found in the tasks that read the sample; the driver gets
the distinct ones with their counts, at most one for each toxic text and each clean sentence of the sampled rows, and fits in blocks of them. Since the kernel is a product of subsequence counts, the trained machine is one weight per subsequence,
so a token costs its subsequences once, not once per landmark. A logistic curve over a hashed share of the learned texts, CALIBRATION in expectation, turns the worst tokens' margins into a score.

Defined cases: a null or empty text, or one without letters, gets the score of a text whose tokens are all harmless. A null doc_id counts as an empty id. Without both labels
among the learned rows every score is 0. Repeated rows are scored each; empty tables give an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cardlake.llm.common import BLANKS, crc_of_id, cut, text_slices

DECAY, ORDER = 0.6, 3
LANDMARKS, CALIBRATION = 400, 20_000
TOXIC_ROWS, CLEAN_ROWS, ROUNDS, RIDGE = 2000, 2000, 4, 1e-4
LONGEST, SIGNS = 14, 64
_SPACED = re.compile(r"(?<!\S)\w(?:[^\w\s]*\s+[^\w\s]*\w){2,}(?!\w)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n|[。！？]")


def form(token: str) -> str:
    return _NOT_LETTERS.sub("", token.lower())


def tokens(text: str | None) -> set[str]:
    """The distinct raw tokens of a text, and its runs of single letters."""
    low = (text or "").lower()
    out = set(low.split())
    out.update("".join(m.split()) for m in _SPACED.findall(low))
    return out


def coded(words: list[str]) -> np.ndarray:
    """For words of one length, a row each of signs 0 to SIGNS - 1: start 0, end 1, a-z from 2, other letters by code point."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int64)
    signs = np.where((points >= 97) & (points <= 122), points - 95, 28 + points % (SIGNS - 28))
    return np.pad(signs, ((0, 0), (1, 1)), constant_values=((0, 0), (0, 1)))


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ascending triples of positions below n, and their weights; n is at most LONGEST + 2."""
    if n not in _PLACES:
        at = np.array(list(combinations(range(n), ORDER)), np.int64)
        _PLACES[n] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _PLACES[n]


def parts(word: str) -> list[str]:
    """A word, or for a long one overlapping parts that cover it."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def column_parts(w: Column) -> Column:
    """parts() as a Column."""
    step = LONGEST // 2
    at = F.sequence(F.lit(0), F.greatest(F.length(w) - step - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(F.transform(at, lambda i: F.substring(w, i + 1, F.lit(LONGEST))))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: codes of their subsequences and the weights, each word's scaled to norm 1."""
    signs = coded(words)
    at, weight = places(signs.shape[1])
    codes = (signs[:, at[:, 0]] * SIGNS + signs[:, at[:, 1]]) * SIGNS + signs[:, at[:, 2]]
    order = np.argsort(codes, axis=1)
    codes, w = np.take_along_axis(codes, order, 1), weight[order]
    # equal subsequences of a word add up before squaring
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    first = np.flatnonzero(new.ravel())
    norm = np.sqrt(np.bincount(first // codes.shape[1], sums**2, minlength=len(words)))
    return codes, w / norm[:, None]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 4000):
            yield at[i : i + 4000], [words[k] for k in at[i : i + 4000]]


def norms(signs: np.ndarray) -> np.ndarray:
    """The norm of the decayed counts of subsequences of each row of signs: its kernel with itself, by sums over pairs of equal signs instead of over subsequences."""
    n, m = signs.shape
    alike = (signs[:, :, None] == signs[:, None, :]) * DECAY**2
    ends = alike  # by pairs of places, the weights of subsequences of one sign that end there
    for _ in range(ORDER - 1):
        before = np.zeros((n, m + 1, m + 1))
        for i in range(m):  # sums of all that ended before either place, decayed by the distance
            before[:, i + 1, 1:] = DECAY * before[:, i, 1:] + ends[:, i]
        for j in range(m):
            before[:, :, j + 1] += DECAY * before[:, :, j]
        ends = alike * before[:, :m, :m]
    return np.sqrt(ends.sum(axis=(1, 2)))


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each word (1 letter at least)."""
    out = np.zeros(len(words))
    for at, some in by_length(words):
        for low in range(0, len(some), 1000):
            signs = coded(some[low : low + 1000])
            where, weight = places(signs.shape[1])
            pairs = signs[:, :, None] * SIGNS + signs[:, None, :]
            codes = pairs[:, where[:, 0], where[:, 1]] * SIGNS + signs[:, where[:, 2]]
            out[at[low : low + 1000]] = weights[codes] @ weight / norms(signs) + bias
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(others)))
    for lo in range(0, len(others), 64):  # the dense side is SIGNS ** ORDER wide
        some_others = others[lo : lo + 64]
        side = np.zeros((len(some_others), SIGNS**ORDER), np.float32)
        for at, some in by_length(some_others):
            codes, w = subsequences(some)
            for k, i in enumerate(at):
                np.add.at(side[i], codes[k], w[k])
        for at, some in by_length(words):
            codes, w = subsequences(some)
            for k, i in enumerate(at):
                out[i, lo : lo + 64] = side[:, codes[k]] @ w[k]
    return out


def spoiled(word: str, seed: int) -> list[str]:
    """The word with a letter inserted and with one doubled, at places drawn from the seed."""
    r = np.random.default_rng([seed, len(word)])
    i, j = int(r.integers(1, len(word))), int(r.integers(0, len(word)))
    return [word[:i] + chr(97 + int(r.integers(0, 26))) + word[i:], word[:j] + word[j] + word[j:]]


def sentences(text: str | None) -> list[str]:
    return [x for x in _SENTENCE_END.split(text or "") if x.strip()]


def token_parts(text: str) -> list[str]:
    """The parts of the distinct forms of a text or sentence, sorted."""
    return sorted({p for t in tokens(text) if (f := form(t)) for p in parts(f)})


class Basis:
    """The landmarks' space: features of words whose inner products are the kernel's projections on it."""

    def __init__(self, marks: list[str]) -> None:
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        kept = values > 1e-4 * values.max()
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        found = [(i, codes[k], w[k]) for at, some in by_length(marks) for codes, w in [subsequences(some)] for k, i in enumerate(at)]
        self.codes = np.unique(np.concatenate([c for _, c, _ in found]))
        self.index = np.full(SIGNS**ORDER, len(self.codes), np.int32)
        self.index[self.codes] = np.arange(len(self.codes))
        sides = np.zeros((len(self.codes) + 1, len(marks)))
        for i, c, w in found:
            np.add.at(sides[:, i], self.index[c], w)
        self.rows = (sides @ whiten).astype(np.float32)
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        new = sorted({w for w in words if w not in self.known})
        n = len(self.rows)
        for _, some in by_length(new):
            for low in range(0, len(some), 500):
                codes, w = subsequences(some[low : low + 500])
                k = len(codes)
                dense = np.bincount((np.arange(k)[:, None] * n + self.index[codes]).ravel(), w.ravel(), minlength=k * n).reshape(k, n)
                self.known.update(zip(some[low : low + 500], dense.astype(np.float32) @ self.rows, strict=True))
        return np.array([self.known[w] for w in words], np.float32).reshape(len(words), self.rows.shape[1])

    def weights(self, w: np.ndarray) -> np.ndarray:
        """One weight per subsequence of a linear function of the features."""
        out = np.zeros(SIGNS**ORDER)
        out[self.codes] = self.rows[:-1] @ w
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, block: int = 4096) -> np.ndarray:
    """The machine's weights, the last for a column of ones, by Newton steps on the rows inside the margin; rows are taken in blocks."""
    n = x.shape[1] + 1
    ridge = np.full(n, RIDGE)
    ridge[-1] = 1e-9
    w = np.zeros(n)
    for _ in range(30):
        left, right = np.diag(ridge), np.zeros(n)
        for i in range(0, len(x), block):
            b = np.hstack([x[i : i + block].astype(float), np.ones((len(x[i : i + block]), 1))])
            inside = y[i : i + block] * (b @ w) < 1
            b, s = b[inside], share[i : i + block][inside]
            left += (b * s[:, None]).T @ b
            right += (b * s[:, None]).T @ y[i : i + block][inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def train_on_worst(basis: Basis, bad: dict[str, int], good: dict[str, int]) -> tuple[np.ndarray, float]:
    """Weights per subsequence and bias, from the worst tokens of toxic texts and of clean sentences with the number of those."""
    more = [(s, n / 4) for w, n in bad.items() if len(w) > 3 for s in spoiled(w, crc32(w.encode()))]
    words = [*bad, *[s for s, _ in more], *good]
    y = np.array([1.0] * (len(bad) + len(more)) + [-1.0] * len(good))
    share = np.array([*bad.values(), *[n for _, n in more], *good.values()], float)
    for side in (y > 0, y < 0):
        share[side] *= 0.5 / share[side].sum()
    w = squared_hinge(basis(words), y, share)
    return basis.weights(w[:-1]), float(w[-1])


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


class Scorer:
    """The three largest margins of texts' distinct tokens; tokens seen before are remembered, up to a number."""

    def __init__(self, model: Model, most: int = 400_000) -> None:
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        sets = [tokens(t) for t in texts]
        known = self.known
        new = sorted({t for s in sets for t in s if t not in known})
        if len(known) + len(new) > self.most:
            known.clear()
            new = sorted({t for s in sets for t in s})
        pieces = [(k, p) for k, t in enumerate(new) if (f := form(t)) for p in parts(f)]
        distinct = sorted({p for _, p in pieces})
        worst = np.full(len(new), -2.0)
        if pieces:
            margin = dict(zip(distinct, margins(distinct, self.model.weights, self.model.bias).tolist(), strict=True))
            np.maximum.at(worst, np.array([k for k, _ in pieces]), [margin[p] for _, p in pieces])
        known.update(zip(new, np.clip(worst, -2, 2).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for i, s in enumerate(sets):
            out[i] = nlargest(3, [-1.0, -1.0, -1.0, *map(known.__getitem__, s)])
        return out


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of y on the columns of x and 1, by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _raw(docs: DataFrame, model: Model, others: list[str]) -> DataFrame:
    """others, _first, _second, _third of each row of docs (others, text)."""
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in text_slices(batches):
            x = scorer(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *[pa.array(x[:, k]) for k in range(3)]], [*others, "_first", "_second", "_third"])

    own = docs.select(*others, "text")
    fields = [f for f in own.schema.fields[:-1]] + [StructField(c, DoubleType()) for c in ("_first", "_second", "_third")]
    return own.mapInArrow(run, StructType(fields))


def _sentences(sample: DataFrame) -> DataFrame:
    """The parts of each toxic text, whose sentences compete, and of each clean sentence; those without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1 << 20):
            found = [(y, x) for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in map(token_parts, [text] if y else sentences(text)) if x]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.string()))], ["toxic", "parts"])

    return sample.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic long, parts array<string>")


def _worst_tokens(bags: DataFrame, weights: np.ndarray, bias: float) -> tuple[dict[str, int], dict[str, int]]:
    """The worst token of each toxic text and of each clean sentence (the first of equal ones), with the number of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            words = b.column(1).flatten().dictionary_encode()
            margin = margins(words.dictionary.to_pylist(), weights, bias)[words.indices.to_numpy()]
            lengths = pc.list_value_length(b.column(1)).to_numpy()
            starts = np.cumsum(lengths) - lengths
            best = np.maximum.reduceat(margin, starts)
            first = np.minimum.reduceat(np.where(margin == np.repeat(best, lengths), np.arange(len(margin)), len(margin)), starts)
            yield pa.RecordBatch.from_arrays([b.column(0), words.take(pa.array(first)).dictionary_decode()], ["toxic", "w"])

    found = bags.mapInArrow(run, "toxic long, w string").groupBy("toxic", "w").agg(F.count("*").alias("n")).orderBy("toxic", "w").collect()
    of = lambda y: {r["w"]: r["n"] for r in found if r["toxic"] == y}
    return of(1), of(0)


def learn(docs: DataFrame) -> Model:
    """A model of labelled rows (doc_id, text, toxic 0 or 1)."""
    rows = docs.filter("toxic in (0, 1) and text is not null")
    spaced = F.array_distinct(F.split(F.lower("text"), BLANKS))
    letters = F.array_remove(F.transform(spaced, lambda w: F.regexp_replace(w, r"[^\p{L}]+", "")), "")
    forms = rows.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(letters, column_parts)))).alias("w"))
    counts = cut(forms.groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "token-counts")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 0.5) / (n[0] + 1.0))
    half = LANDMARKS // 2
    telling = {r["w"]: r["bad"] for r in counts.filter("bad > 0").filter(odds > 0).orderBy(F.desc(odds), F.desc("bad"), "w").limit(half).collect()}
    usual = {r["w"]: r["good"] for r in counts.filter("good > 0").filter(odds <= 0).orderBy(F.desc("good"), "w").limit(half).collect()}
    if not telling or not usual:
        return Model()
    basis = Basis([*telling, *usual])
    weights, bias = train_on_worst(basis, telling, usual)
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40))
    limit = lambda most, of: int((1 << 40) * min(1.0, most / of))
    sample = rows.filter(place < F.when(F.col("toxic") == 1, limit(TOXIC_ROWS, n[1])).otherwise(limit(CLEAN_ROWS, n[0])))
    bags = cut(_sentences(sample), "sentences")
    clean: dict[str, int] = {}
    for _ in range(ROUNDS):
        bad, good = _worst_tokens(bags, weights, bias)
        for token, k in good.items():
            clean[token] = clean.get(token, 0) + k
        if not bad or not clean:
            break
        weights, bias = train_on_worst(basis, bad, clean)
    chosen = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 40)) < limit(CALIBRATION, sum(n.values()))
    model = Model(weights, bias)
    seen = _raw(rows.filter(chosen), model, ["toxic"]).toPandas()
    x = seen[["_first", "_second", "_third"]].to_numpy()
    return Model(weights, bias, curve(x, seen["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with score (0 to 1)."""
    others = [c for c in docs.columns if c not in ("text", "score")]
    if model.weights is None:
        return docs.select(*others).withColumn("score", F.lit(0.0))
    a, b, c, d = model.curve
    z = F.lit(a) * F.col("_first") + F.lit(b) * F.col("_second") + F.lit(c) * F.col("_third") + F.lit(d)
    return _raw(docs, model, others).select(*others, (1 / (1 + F.exp(-z))).alias("score"))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 3 == 1
