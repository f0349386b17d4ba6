"""Phrase collocation mining by best-first branch-and-bound growth, exact for each language's first `top` phrases.

A text is lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`; counts are by language. Candidates are phrases of two or three
words with a >= `least` occurrences. A phrase's score is that of its lowest cut, floor(1000000 a a / (l r)), and a candidate is dropped if a longer candidate that holds
its words has at least `share` per cent of its occurrences.

Growth. Words with fewer than `least` occurrences start no candidate, so pairs are counted of the others only. A pair's count bounds all it can grow to: a triple (x, y, z) has
a <= f(x y) and its first cut has r >= a, so its score is at most 1000000 f(x y) / f(x). The frontier of a language is the pairs whose bound reaches a floor; one pass
over the texts counts the triples that start or end with a pair of the frontier (those that end with one settle whether it is dropped). All candidates at or above the
floor are then known. A language is settled when `top` of them survive or nothing is left below the floor; else its floor is lowered to take in four times as many
and the frontier grows. Ties at the floor are inside, as the floor itself is.

At scale. Texts are read once for words, once for pairs and once for each round; a task counts within bounded runs of words before anything is shuffled. Words and frontier pairs
reach the tasks as a bitmap of BITS bits, whatever their number: a false hit only adds rows that the exact joins drop. Tops of a language are taken in slices first.

Defined cases: a null text is empty, a null language is `und`. Repeated rows count each time. Empty tables, and languages without candidates, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.llm.common import cut, release, text_slices

TOP, LEAST, SHARE = 2000, 10, 50
#: Bits of the bitmap that tasks test words and pairs with: 8 MB.
BITS = 1 << 26
#: Words that a task counts at once.
RUN = 4_000_000
SALTS = 16

_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Numbers for one language's words, 0 for the break between pieces; and a hash of each."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0, b"": -1})
        self.words, self.hashes, self.seed = [b"\n"], [0], lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(self.seed + word))
        return n

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The words of all texts, with breaks between pieces and texts."""
        raw = "\n".join(texts).encode().lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return ids[ids >= 0]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of two words' hashes, in this order."""
    mixed = first * _ODD + second
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(BITS)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(rows: DataFrame, words: list[str]) -> np.ndarray:
    """A bitmap of the hashes of rows (lang and one or two words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = np.zeros(BITS // 64, np.uint64)
        for b in batches:
            langs = [x.encode() + b"\0" for x in b.column(0).to_pylist()]
            hashes = [np.array([xxhash.xxh3_64_intdigest(k + w.encode()) for k, w in zip(langs, b.column(i).to_pylist(), strict=True)], np.uint64) for i in range(1, b.num_columns)]
            slot = (hashes[0] if len(hashes) == 1 else pair_hash(*hashes)) % np.uint64(BITS)
            np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(bits)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bits[part].view(np.int64))], ["at", "bits"])

    found = rows.select("lang", *words).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _runs(ids: np.ndarray, size: int, words: Vocabulary, known: np.ndarray | None) -> list[np.ndarray]:
    """The places' words of all phrases of a size: arrays of first, second, third words. known: of size 2, tests its words; of size 3, its pairs."""
    cols = [ids[i : len(ids) - size + 1 + i] for i in range(size)]
    ok = np.logical_and.reduce([c > 0 for c in cols])
    if known is not None and size == 2:
        frequent = _has(known, np.array(words.hashes, np.uint64))
        ok &= frequent[cols[0]] & frequent[cols[1]]
    elif known is not None and size == 3:
        hashes = np.array(words.hashes, np.uint64)
        inside = _has(known, pair_hash(hashes[ids[:-1]], hashes[ids[1:]]))
        ok &= inside[:-1] | inside[1:]
    return [c[ok] for c in cols]


def _counted(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of numbers below 2 ** 32, and how often each occurs."""
    if len(cols) == 1:
        keys, n = np.unique(cols[0], return_counts=True)
        return [keys], n
    keys, n = np.unique(cols[0] << 32 | cols[1], return_counts=True)
    if len(cols) == 2:
        return [keys >> 32, keys & 0xFFFFFFFF], n
    at = np.searchsorted(keys, cols[0] << 32 | cols[1])
    (pair, last), n = _counted([at, cols[2]])
    return [keys[pair] >> 32, keys[pair] & 0xFFFFFFFF, last], n


def counts(docs: DataFrame, size: int, known: np.ndarray | None = None) -> DataFrame:
    """lang, w1 .. w{size}, a: occurrences of phrases, of all or of those that known has (see _runs)."""
    names = [f"w{i}" for i in range(1, size + 1)]
    fields = pa.schema([("lang", pa.string()), *[(x, pa.string()) for x in names], ("a", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        found: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (words, ids) in found.items():
                cols, n = _counted(_runs(np.concatenate(ids), size, words, known))
                text = pa.array(words.words, pa.binary()).cast(pa.string())
                for i in range(0, len(n), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[part]), pa.string()), *[text.take(pa.array(c[part])) for c in cols], pa.array(n[part])], schema=fields)
            found.clear()
            release()

        for b in text_slices(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                words, ids = found.setdefault(lang, (Vocabulary(lang), []))
                ids += [words.numbers(texts), np.zeros(1, np.int64)]
                waiting += len(ids[-2])
            if waiting >= RUN:
                yield from out()
                waiting = 0
        yield from out()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, ", ".join([f"{x} string" for x in ["lang", *names]] + ["a long"])).groupBy("lang", *names).agg(F.sum("a").alias("a"))


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    return F.expr(f"cast({a} as decimal(19, 0)) * cast({a} as decimal(12, 0)) * 1000000 div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))")


def scored_pairs(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, w1, w2, a, l, r, score, bound (no triple that starts with the pair scores higher)."""
    left, right = words.select("lang", F.col("w1"), F.col("a").alias("l")), words.select("lang", F.col("w1").alias("w2"), F.col("a").alias("r"))
    both = pairs.join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    return both.select("lang", "w1", "w2", "a", "l", "r", cut_score("a", "l", "r").alias("score"), F.expr("cast(a as decimal(19, 0)) * 1000000 div l").alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, w1, w2, w3, a, l, r, score of the lowest cut; the first of equal ones."""
    start = pairs.select("lang", "w1", "w2", F.col("a").alias("_l2"), F.col("l").alias("_l1"))
    end = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("_r1"), F.col("r").alias("_r2"))
    cuts = [F.struct(cut_score("a", f"_l{k}", f"_r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")) for k in (1, 2)]
    return triples.join(start, ["lang", "w1", "w2"]).join(end, ["lang", "w2", "w3"]).withColumn("_cut", F.least(*cuts)).select("lang", "w1", "w2", "w3", "a", "_cut.l", "_cut.r", "_cut.score")


def first_of_each(rows: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The first rows of each language, with their rank; within slices first, so that a language is not one task's."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("_salt")


def survivors(pairs: DataFrame, triples: DataFrame, floors: DataFrame, share: int) -> DataFrame:
    """All candidates at or above their language's floor that no longer one takes along: lang, phrase, a, l, r, score."""
    longer = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("_longer"))
    two = pairs.join(floors, "lang").filter("score >= floor").join(longer, ["lang", "w1", "w2"], "left").filter(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True)))
    three = triples.join(floors, "lang").filter("score >= floor")
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return two.withColumn("phrase", F.concat_ws(" ", "w1", "w2")).select(*columns).union(three.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")).select(*columns))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, first_floor: int | None = None) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score. first_floor: the first floor is the score of the pair of this rank; by default twice top."""
    words = cut(counts(docs, 1), "words")
    frequent = words.filter(F.col("a") >= least)
    pairs = cut(counts(docs, 2, bitmap_of(frequent, ["w1"])).filter(F.col("a") >= least), "pairs")
    pairs = cut(scored_pairs(frequent, pairs), "scored-pairs")
    by_score = [F.desc("score"), F.desc("a"), F.asc("w1"), F.asc("w2")]
    depth, open_langs, done = first_floor or 2 * top, pairs.select("lang").distinct(), None
    while True:
        ranked = first_of_each(pairs.join(open_langs, "lang", "left_semi"), depth, by_score)
        floors = cut(ranked.groupBy("lang").agg(F.when(F.max("rank") == depth, F.min("score")).otherwise(0).alias("floor")), "floors")
        frontier = pairs.join(floors, "lang").filter("bound >= floor")
        triples = counts(docs, 3, bitmap_of(frontier, ["w1", "w2"])).filter(F.col("a") >= least)
        found = cut(survivors(pairs, cut(scored_triples(triples, pairs), "triples"), floors, share), "survivors")
        settled = floors.join(found.groupBy("lang").count(), "lang", "left").select("lang", ((F.col("floor") == 0) | F.coalesce(F.col("count") >= top, F.lit(False))).alias("settled"))
        found = found.join(settled.filter("settled"), "lang", "left_semi")
        done = found if done is None else done.union(found)
        open_langs = cut(settled.filter("not settled").select("lang"), "open")
        if open_langs.isEmpty():
            break
        depth *= 4
    best = first_of_each(done, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return best.join(words.groupBy("lang").agg(F.sum("a").alias("n")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
