"""Near-duplicate classes by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its shingles (SHINGLE consecutive words; all words, if it has fewer). Similarity is weighted Jaccard: the sum of
smaller counts over the sum of larger ones. Documents at THRESHOLD or more are linked; classes are the connected components of links, named by
their smallest id.

Signatures: a shingle's counts 0, 1, 2-3, 4-7, ... are blocks with a Poisson process each, of a rate equal to the block's size, whose points carry a
signature position and a count level; a point belongs to a document if the level is below the shingle's count there. Each
position keeps its earliest point. Points come in order of time, and only those before a document's stop time are made, so the cost
follows the signature's length rather than its product with the document's; where a position is still empty, the stop time is doubled.
Two documents agree in a position with a probability equal to their similarity.

Plan: equal word sequences are first reduced to one representative (the row with the smallest id). Representatives that share a band key meet in a
bucket. Narrow bucket rows are joined into candidate components; a component of at most UNIT documents is one unit of work, a larger one is split
by bucket, and a bucket larger than that into blocks. What a block's documents and the bucket's leader have in common makes classes; then the documents of each
large bucket that are outside its largest class are compared, block by block, with all the others, so every pair that shares a bucket is compared or in one class
already, a bucket of near copies takes work in proportion to its size, and no task holds more than 2 * UNIT documents. In a unit, pairs whose signatures agree in at least SCREEN of the positions (six standard deviations below the threshold) are verified
exactly, most alike first, unless links already found join them; a unit gives at most as many links as documents. Keys that are hot, of copies or of bands, are
joined without a shuffle.

Missed links: a pair at exactly 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 1.5e-5.

Defined cases: null, empty and blank texts have no shingles and are classes of their own. A row belongs to the class of its text, whatever
its id: rows of equal id and different text are judged each, so classes may have the same name where ids collide; a row without an id can be in a class that others name, and a class
without any id has a null name. Repeated rows each keep a result row. An empty table gives an empty result. Input columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import cut, join_counted, let, text_slices, words
from cardlake.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
POSITIONS = BANDS * ROWS
SCREEN, UNIT = 0.6, 3000
#: Large buckets whose classes (some numbers a bucket) are broadcast, if there are no more.
MOST_LARGE = 100_000
#: The names (three numbers) of documents to compare are broadcast to the texts up to this many; beyond, both are shuffled.
BROADCAST_ROWS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_bags(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each document, one after the other, and the documents' offsets in them."""
    n = np.diff(offsets)
    start, counts = offsets[:-1], np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(n)), counts)
    at = start[doc] + (np.arange(bounds[-1]) - bounds[doc])
    padded = np.concatenate([hashes.view(np.uint64), np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        word = padded[at + k]
        short = n[doc] <= k
        if short.any():
            word = np.where(short, np.uint64(k + 1), word)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    for i in np.flatnonzero(counts > 1):
        out[bounds[i] : bounds[i + 1]].sort()
    return out, bounds


def numbered(bag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of sorted bags: how often its shingle came before in the same bag; and whether it is the last of its kind."""
    new = np.ones(len(bag) + 1, bool)
    new[1:-1] = bag[1:] != bag[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(new[:-1])
    nth = np.arange(len(bag)) - np.repeat(first, np.diff(np.append(first, len(bag))))
    return nth, new[1:]


def signatures(bag: np.ndarray, bounds: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """Documents x positions, 32-bit names of the earliest points; bags must not be empty."""
    nth, last = numbered(bag, bounds)
    total = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(total)), total)[last]
    shingle, weight = bag[last], nth[last] + 1
    # a process for each block of counts that a shingle reaches into
    parts = [(doc_of, shingle, weight, np.zeros_like(weight), np.ones_like(weight))]
    low = 1
    while (reach := weight > low).any():
        parts.append((doc_of[reach], shingle[reach], weight[reach], np.full(reach.sum(), low), np.full(reach.sum(), low)))
        low *= 2
    doc_of, shingle, weight, low_of, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed_of = mix(shingle + (low_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    best = np.full(len(total) * positions, np.inf)
    todo = np.ones(len(total), bool)
    stop = positions * (np.log(positions) + 7) / np.maximum(total, 1)
    while todo.any():
        live = np.flatnonzero(todo[doc_of])
        best.reshape(-1, positions)[todo] = np.inf
        time, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            r = mix(seed_of[live] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / size[live]
            on = time <= stop[doc_of[live]]
            live, time, r = live[on], time[on], mix(r[on])
            position = ((r >> np.uint64(32)) * np.uint64(positions)) >> np.uint64(32)
            wide = size[live]
            level = low_of[live] + (((r & np.uint64(0xFFFFFFFF)) * wide.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            own = level < weight[live]
            np.minimum.at(best, doc_of[live[own]] * positions + position[own].astype(np.int64), time[own])
        todo = np.isinf(best.reshape(-1, positions)).any(axis=1)
        stop = stop * 2
    return (mix(best.view(np.uint64).copy()) >> np.uint64(32)).astype(np.uint32).reshape(-1, positions)


def band_keys(sigs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sigs), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sigs[:, k::rows].astype(np.uint64))
    return out.view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def row_keys(docs: DataFrame) -> list[Column]:
    """r1, r2: 128 bits that name a row's id and text."""
    return [F.xxhash64(F.lit(k), docs["doc_id"].cast("long"), docs["text"]).alias(f"r{k}") for k in (1, 2)]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, k1, k2 (of the word sequence), keys (of bands) and sig for each document with words."""
    of_words = lambda ws: F.struct(F.transform(ws, lambda w: F.xxhash64(w)).alias("ws"), F.xxhash64(F.lit(1), ws).alias("k1"), F.xxhash64(F.lit(2), ws).alias("k2"))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(docs), let(words(F.col("text")), of_words).alias("w")).filter(F.size("w.ws") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 6 << 20):
            bag, bounds = shingle_bags(*_flat(b.column(5)))
            sigs = signatures(bag, bounds)
            keys = band_keys(sigs)
            n = len(sigs)
            out = [*b.columns[:5], _lists(keys.ravel(), np.arange(n + 1) * BANDS), _lists(sigs.ravel().view(np.int32), np.arange(n + 1) * POSITIONS)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "r1", "r2", "k1", "k2", "keys", "sig"])

    return split.select("doc_id", "r1", "r2", "w.k1", "w.k2", "w.ws").mapInArrow(run, "doc_id long, r1 long, r2 long, k1 long, k2 long, keys array<long>, sig array<int>")


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, bag: the shingles with their number among equal ones, hashed and sorted: the overlap of two such sets is that of the multisets."""
    split = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 6 << 20):
            bag, bounds = shingle_bags(*_flat(b.column(1)))
            nth, _ = numbered(bag, bounds)
            named = mix(bag + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            for i in range(len(bounds) - 1):
                named[bounds[i] : bounds[i + 1]].sort()
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(named.view(np.int64), bounds)], ["doc_id", "bag"])

    return split.mapInArrow(run, "doc_id long, bag array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(both) - shared


def unit_links(ids: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join all documents of a unit that links at or above threshold join. side: only pairs of different sides count, unless all are 0."""
    n, label = len(ids), np.arange(len(ids))
    across = bool(side.any())
    pairs, agreed = [], []
    for i in range(n - 1):
        same = (sigs[i + 1 :] == sigs[i]).sum(axis=1)
        ok = same >= SCREEN * sigs.shape[1]
        if across:
            ok &= side[i + 1 :] != side[i]
        at = np.flatnonzero(ok)
        if len(at):
            pairs.append(np.stack([np.full(len(at), i), at + i + 1], axis=1).astype(np.int32))
            agreed.append(same[at].astype(np.int16))
    out: list[tuple[int, int]] = []
    if not pairs:
        return out
    all_pairs = np.concatenate(pairs)
    all_pairs = all_pairs[np.argsort(-np.concatenate(agreed), kind="stable")]
    at, step = 0, 64
    while at < len(all_pairs):
        part = all_pairs[at : at + step]
        at, step = at + step, min(step * 2, 4096)
        for i, j in part[label[part[:, 0]] != label[part[:, 1]]].tolist():
            if label[i] == label[j]:
                continue
            shared, union = similarity(sets[i], sets[j])
            if shared >= threshold * union - 1e-9:
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def units(bucket_rows: DataFrame, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Where candidate documents are compared first: (doc_id, unit, part, side); and the rows (doc_id, key, leader, n) of buckets of more than unit documents.

    A component of at most unit documents is one part of work. The buckets of a larger one are parts of their own; those of more than unit documents are
    cut into blocks, each of which has the bucket's leader with it.
    """
    sizes = cut(bucket_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).filter("n > 1"), "bucket-sizes")
    shared = cut(join_counted(bucket_rows, sizes, ["key"]), "buckets")
    comps = components(shared.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
    big = comps.groupBy("component").count().filter(F.col("count") > unit).select("component")
    whole = comps.join(big, "component", "left_anti").select(F.col("node").alias("doc_id"), F.col("component").alias("unit"), F.lit(-1).alias("part"), F.lit(0).alias("side"))
    in_big = cut(shared.join(comps.join(big, "component", "left_semi").select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), "large-components")
    blocks = F.ceil(F.col("n") / unit).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    places = F.when(F.col("doc_id") == F.col("leader"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    split = in_big.select("doc_id", F.col("key").alias("unit"), F.explode(places).alias("part"), F.lit(0).alias("side"))
    return whole.unionByName(split), in_big.filter(F.col("n") > unit)


def strays(large: DataFrame, joined: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, unit, part, side): for each large bucket, its documents outside the bucket's largest class so far (strays), block by block against all others.

    Documents of one class need no comparison, so this is all that is left; the work is the number of strays times the bucket's size.
    """
    named = large.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = cut(named.groupBy("key", "component").agg(F.count("*").alias("m")), "bucket-classes")
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("m_main"), F.sum("m").alias("m_all")).filter("m_main < m_all")
    placed = named.join(F.broadcast(main) if main.count() <= MOST_LARGE else main, "key").withColumn("stray", F.col("component") != F.col("main"))
    n_stray, n_main = (F.ceil(x / unit).cast("int") for x in (F.col("m_all") - F.col("m_main"), F.col("m_main")))
    width = n_stray + n_main
    block = F.when(F.col("stray"), F.pmod(F.xxhash64("doc_id"), n_stray)).otherwise(n_stray + F.pmod(F.xxhash64("doc_id"), n_main)).cast("int")
    # strays meet every block, the others the strays' blocks
    others = F.when(F.col("stray"), F.sequence(F.lit(0), width - 1)).otherwise(F.sequence(F.lit(0), n_stray - 1))
    met = placed.select("doc_id", F.col("key").alias("unit"), block.alias("block"), width.alias("width"), F.explode(others).alias("other"))
    part = F.least("block", "other") * F.col("width") + F.greatest("block", "other")
    side = F.when(F.col("other") == F.col("block"), 0).when(F.col("block") > F.col("other"), 2).otherwise(1)
    return met.select("doc_id", "unit", part.cast("int").alias("part"), side.alias("side"))


def links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that join what similar representatives make a class. nodes: node, rep, keys, sig of the representatives; docs holds their texts."""
    sigs = nodes.select(F.col("node").alias("doc_id"), "keys", "sig")
    where, large = units(sigs.select("doc_id", F.explode("keys").alias("key")))
    where = cut(where, "units")
    texts = cut(nodes.select(F.col("node").alias("doc_id"), "rep.r1", "rep.r2").join(where.select("doc_id").distinct(), "doc_id", "left_semi"), "compared")
    texts = F.broadcast(texts) if texts.count() <= BROADCAST_ROWS else texts
    sets = bags(docs.select(*row_keys(docs), "text").join(texts, ["r1", "r2"]).select("doc_id", "text")).dropDuplicates(["doc_id"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["doc_id"].to_numpy()
        sig = np.stack([x.values.to_numpy() for x in table["sig"]])
        bag = [x.values.to_numpy() for x in table["bag"]]
        found = unit_links(ids, sig, bag, table["side"].to_numpy(), threshold)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    compared = lambda places: places.join(sigs.select("doc_id", "sig"), "doc_id").join(sets, "doc_id").groupBy("unit", "part").applyInArrow(run, "a long, b long")
    first = cut(compared(where), "links")
    if large.isEmpty():
        return first
    return first.unionByName(compared(strays(large, components(first))))


def _named(docs: DataFrame, threshold: float) -> DataFrame:
    """docs with _r1, _r2 and _rep: the representative (no_id, doc_id, r1, r2) of the row's class, null for a text without words."""
    found = cut(signed(docs), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")).alias("rep")
    # equal word sequences have equal keys and signatures
    nodes = cut(found.groupBy("k1", "k2").agg(rep, F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "representatives")
    joined = cut(components(links(docs, nodes, threshold)), "joined")
    best = joined.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("best"))
    of_node = joined.join(best, "component").select("node", "best")
    of_words = cut(nodes.select("node", "k1", "k2", "n", "rep").join(of_node, "node", "left").select("k1", "k2", "n", F.coalesce("best", "rep").alias("_rep")), "classes")
    of_row = join_counted(found.select("r1", "r2", "k1", "k2"), of_words, ["k1", "k2"]).select("r1", "r2", "_rep").dropDuplicates(["r1", "r2"])
    keyed = docs.select("*", *[k.alias(f"_r{i}") for i, k in enumerate(row_keys(docs), 1)])
    return keyed.join(of_row, (keyed["_r1"] == of_row["r1"]) & (keyed["_r2"] == of_row["r2"]), "left").drop("r1", "r2")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with class_id: the smallest id of the document's class."""
    named = _named(docs.drop("class_id"), threshold)
    return named.withColumn("class_id", F.when(F.col("_rep").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("_rep.doc_id"))).drop("_r1", "_r2", "_rep")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, one with the smallest id; of a text without words, one row of each id and text."""
    named = _named(docs, threshold)
    kept = named.filter(F.col("_rep").isNull() | ((F.col("_rep.r1") == F.col("_r1")) & (F.col("_rep.r2") == F.col("_r2"))))
    return kept.dropDuplicates(["_r1", "_r2"]).select(*docs.columns)
