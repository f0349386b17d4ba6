"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIM signs, derived from its code point. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
as often as letters follow it; a text's vector bundles (adds) those of its n-grams, where runs of other characters are one boundary sign and no n-gram
reaches over a boundary. A language's prototype bundles all learned texts of that language; documents go to the prototype with the largest cosine.

Bundling is linear, so a task counts n-grams per slice of texts and multiplies the counts with the n-grams' vectors, GRAMS n-grams at a time, so that memory
follows the slice (SLICE bytes, or one longer text) and not the number of distinct n-grams times DIM. Learning sums
fixed-size vectors per language and reads every learned row; prototypes (DIM numbers per language) are all that is sent to tasks.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text where nothing was learned. Ties go to the
language first in order. A null doc_id counts as an empty id. Rows with a null language aren't learned. Repeated rows are scored each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import crc_of_id, text_slices

DIM, SEED = 512, 20
SLICE = 2 << 20
GRAMS, CELLS = 8192, 4_000_000


class Letters:
    """Rows of letter vectors, made as letters appear. Row 0 is the boundary."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        self.dim, self.seed = dim, seed
        self.row = np.full(0x110000, -1, np.int32)
        self.vectors = [self._vector(0x110000)]

    def _vector(self, code: int) -> np.ndarray:
        return np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.float32), self.dim)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        out = self.row[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                if chr(code).isalpha():
                    self.row[code] = len(self.vectors)
                    self.vectors.append(self._vector(code))
                else:
                    self.row[code] = 0
            out = self.row[codes]
        return out

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each n-gram its text and its number among the distinct ones, and the letters' rows of those."""
        low = [t.lower() for t in texts]
        n = np.array([len(t) for t in low], np.int64)
        codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(low)), n + 1)
        text = np.append(text, text[-1:] if len(text) else [0])
        rows = self.rows(codes)
        kept = np.ones(len(rows), bool)
        kept[1:] = (rows[1:] != 0) | (rows[:-1] != 0)
        rows, text = rows[kept].astype(np.int64), text[kept]
        a, b, c = rows[:-2], rows[1:-1], rows[2:]
        inner = b != 0
        k = len(self.vectors)
        code, owner = ((a * k + b) * k + c)[inner], text[1:-1][inner]
        if k <= 160:
            seen = np.zeros(k**3, bool)
            seen[code] = True
            distinct = np.flatnonzero(seen)
            number = np.zeros(k**3, np.int32)
            number[distinct] = np.arange(len(distinct))
            gram = number[code]
        else:
            distinct, gram = np.unique(code, return_inverse=True)
        return owner, gram, np.stack([distinct // (k * k), distinct // k % k, distinct % k])

    def bundles(self, owner: np.ndarray, gram: np.ndarray, letters: np.ndarray, owners: int) -> np.ndarray:
        """owners x dim: the sum of each owner's n-gram vectors. Vectors are made for GRAMS n-grams at a time, and counts for as many owners as CELLS allows."""
        v = np.stack(self.vectors)
        twice, once = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
        out = np.zeros((owners, self.dim), np.float64)
        parts = range(0, letters.shape[1], GRAMS)
        if len(parts) > 1:  # by part of the n-grams, then by owner
            order = np.lexsort((owner, gram // GRAMS))
            owner, gram = owner[order], gram[order]
        elif len(owner) and (np.diff(owner) < 0).any():
            order = np.argsort(owner, kind="stable")
            owner, gram = owner[order], gram[order]
        ends = np.searchsorted(gram // GRAMS, np.arange(len(parts) + 1)) if len(parts) > 1 else [0, len(gram)]
        for k, low in enumerate(parts):
            a, b, c = letters[:, low : low + GRAMS]
            bound, u = twice[a] * once[b] * v[c], len(a)
            who, which = owner[ends[k] : ends[k + 1]], gram[ends[k] : ends[k + 1]] - low
            step = max(1, CELLS // u)
            for at in range(0, owners, step):
                n = min(step, owners - at)
                lo, hi = np.searchsorted(who, [at, at + n])
                if hi > lo:
                    counts = np.bincount((who[lo:hi] - at) * u + which[lo:hi], minlength=n * u).reshape(n, u)
                    out[at : at + n] += counts.astype(np.float32) @ bound
        return out


def learn(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """The prototype of each language of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dim, seed), {}
        for b in text_slices(batches, SLICE):
            langs = b.column(1).to_pylist()
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs])
            owner, gram, triples = letters.grams(b.column(0).to_pylist())
            for name, v in zip(names, letters.bundles(index[owner], gram, triples, len(names)), strict=True):
                sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, v array<long>")
    out: dict[str, np.ndarray] = {}
    for lang, i, x in parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x")).collect():
        out.setdefault(lang, np.zeros(dim))[i] = x
    return {k: v for k, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = SEED) -> DataFrame:
    """docs with lang_pred and score, the cosine (0 at least)."""
    names = list(prototypes)
    unit = np.stack([v / np.linalg.norm(v) for v in prototypes.values()]).astype(np.float32) if names else None
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = docs.select(*others)
    at = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(unit.shape[1] if unit is not None else DIM, seed)
        for b in text_slices(batches, SLICE):
            n = b.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if unit is not None:
                owner, gram, triples = letters.grams([t or "" for t in b.column(at).to_pylist()])
                v = letters.bundles(owner, gram, triples, n)
                size = np.linalg.norm(v, axis=1)
                cosine = (v @ unit.T) / np.maximum(size, 1e-9)[:, None]
                there = np.bincount(owner, minlength=n) > 0
                best = np.where(there, cosine.argmax(axis=1), -1)
                score = np.where(there, np.clip(cosine.max(axis=1), 0, 1), 0)
            lang = pa.array([names[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, pa.array(score.astype(float))], [*others, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 0
