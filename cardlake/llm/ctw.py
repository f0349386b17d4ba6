"""Language-model scoring by context-tree weighting over bytes, and a word-count baseline.

A byte is eight binary decisions, each of which has a context tree of its own over the bytes before it. A node's Krichevsky-Trofimov estimate is mixed, in equal
parts, with what its children (contexts one byte longer) say together, so every depth up to DEPTH has a weight that the
training counts decide. Trained once and frozen, the mixture is a table: a byte's log10 chance after each context that was seen.

Texts are lower-cased (A-Z) UTF-8 with byte 255, which UTF-8 never holds, before and after. Counts of (context, byte) are made in the tasks that read
the texts and summed by a shuffle, over all training texts. A tree is weighted per group of contexts with the same last two bytes (65,536 at most), one subtree of three
bytes after the other, so a task holds a subtree and not a group; a group's summary of
fixed size is all that reaches the driver, where the two uppermost levels are done. The table is written to the shared folder in slices of about MODEL_BYTES by the last two bytes;
each pass over the texts scores the positions of one slice, so a Python worker holds one slice however many contexts there are. A worker holds log10 chances as 16-bit floats (11 bits), so a
text's score is the model's probability but for errors of about 0.02 % of each byte's part, which mostly cancel out.

Base score: log10((c + 0.5) / (N + 0.5 (V + 1))) per token, with counts over all training tokens. Words are known by a 64-bit hash. Counts of frequent
words (as many as HOT_WORDS, found by a histogram of counts) are broadcast; other tokens meet theirs in a shuffle join.

Defined cases: a null text is an empty one: its only token is the end, and the model scores its end byte. A null doc_id counts as an empty id. Rows that are equal in id
and text are scored alike and each kept. Without training texts every byte has chance 1/256, N and V are 0. A byte that training never saw has its chance without
context. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import ascii_lower, crc_of_id, cut, release, scratch, text_slices, words

DEPTH, EDGE, HOT_WORDS = 5, 255, 200_000
#: What a slice of the table may take in a worker; bytes there for each context and byte; and contexts for each row of counts, about (a context has two bytes after it or more).
MODEL_BYTES, CELL_BYTES, CONTEXTS_PER_COUNT = 600 << 20, 6, 0.5
LOG2 = math.log(2)


# ---- bytes and contexts ----


def byte_stream(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes with depth edge bytes before each and after the last; positions to predict; and the text of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edge = bytes([EDGE]) * depth
    stream = np.frombuffer(edge + edge.join(raw) + edge, np.uint8)
    upper = (stream >= 65) & (stream <= 90)
    stream = np.where(upper, stream + np.uint8(32), stream)
    n = np.array([len(r) for r in raw], np.int64)
    starts = depth + np.concatenate([[0], np.cumsum(n[:-1] + depth)])
    text = np.repeat(np.arange(len(raw)), n + 1)
    first = np.concatenate([[0], np.cumsum(n[:-1] + 1)])
    return stream, starts[text] + np.arange(len(text)) - first[text], text


def context_keys(stream: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The last bytes, the latest highest, then the byte itself: sorted keys have the contexts of a node side by side."""
    rolled = np.zeros(len(stream), np.uint64)
    for k in range(1, depth + 1):
        rolled[k:] |= stream[:-k].astype(np.uint64) << np.uint64(8 * (depth - k + 1))
    return (rolled | stream.astype(np.uint64))[at]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def context_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = merged(parts)
            parts.clear()
            for i in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000].view(np.int64)), pa.array(counts[i : i + 200_000])], ["key", "n"])

        for b in text_slices(batches, 2 << 20):
            stream, at, _ = byte_stream(b.column(0).to_pylist(), depth)
            parts.append(np.unique(context_keys(stream, at, depth), return_counts=True))
            held += len(parts[-1][0])
            if held > 2_000_000:
                parts[:] = [merged(parts)]
                held = len(parts[0][0])
                if held > 1_500_000:
                    yield from out()
                    held = 0
        if parts:
            yield from out()
        release()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# ---- weighting ----

_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(4096)])


def lgamma_halves(k: np.ndarray) -> np.ndarray:
    """log Gamma(k / 2): a table for small k, Stirling's series for the rest."""
    out = _SMALL[np.minimum(k, 4095)]
    big = k > 4095
    if big.any():
        x = k[big] / 2.0
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def node_counts(leaves: np.ndarray) -> np.ndarray:
    """contexts x 512: how often each node of the byte's binary tree was reached; leaf b is node 256 + b."""
    t = np.zeros((len(leaves), 512), np.int64)
    t[:, 256:] = leaves
    for low in (128, 64, 32, 16, 8, 4, 2, 1):
        t[:, low : 2 * low] = t[:, 2 * low : 4 * low : 2] + t[:, 2 * low + 1 : 4 * low : 2]
    return t


def kt(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes 0 to 255 (0 is unused): log of the KT block probability, and the KT chance of a 1."""
    zeros, ones = t[:, 0::2], t[:, 1::2]
    zeros, ones = zeros.copy(), ones.copy()
    zeros[:, 0] = ones[:, 0] = 0
    log_pe = lgamma_halves(2 * zeros + 1) + lgamma_halves(2 * ones + 1) - lgamma_halves(2 * (zeros + ones) + 2) - math.log(math.pi)
    return log_pe, (ones + 0.5) / (zeros + ones + 1.0)


@dataclass
class Level:
    """Contexts of one depth: their keys, the row of each in the level above, KT chances and the weight of stopping here."""

    contexts: np.ndarray
    parent: np.ndarray
    p1: np.ndarray
    stop: np.ndarray
    log_pw: np.ndarray = field(repr=False)
    leaves: np.ndarray = field(repr=False)


def weighted(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels from depth down to top, for sorted keys that share their last top bytes."""
    contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
    leaves = np.zeros((len(contexts), 256), np.int64)
    leaves[inverse, (keys & np.uint64(255)).astype(np.int64)] = counts
    levels: list[Level] = []
    children: np.ndarray | None = None
    for d in range(depth, top - 1, -1):
        log_pe, p1 = kt(node_counts(leaves))
        log_pw = log_pe if children is None else np.logaddexp(log_pe, children) - LOG2
        stop = np.ones_like(p1) if children is None else np.exp(log_pe - LOG2 - log_pw)
        upper, parent = np.unique(contexts >> np.uint64(8), return_inverse=True)
        levels.append(Level(contexts, parent, p1, stop, log_pw, leaves))
        if d > top:
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            children, leaves, contexts = np.add.reduceat(log_pw, first, axis=0), np.add.reduceat(leaves, first, axis=0), upper
    return levels[::-1]


def mixed(level: Level, sure: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the levels to this one give a 1, and the weight that is left for deeper ones, from the same of the level above, by row."""
    return sure + left * level.stop * level.p1, left * (1 - level.stop)


def log_chances(sure: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of each byte's chance if no deeper context was seen: what is left goes to both bits evenly."""
    p1 = np.clip(sure + left / 2, 1e-300, 1)
    zero, one = np.log10(np.maximum(1 - p1, 1e-300)), np.log10(p1)
    t = np.zeros((len(p1), 512))
    for low in (1, 2, 4, 8, 16, 32, 64, 128):
        t[:, 2 * low : 4 * low : 2] = t[:, low : 2 * low] + zero[:, low : 2 * low]
        t[:, 2 * low + 1 : 4 * low : 2] = t[:, low : 2 * low] + one[:, low : 2 * low]
    return t[:, 256:].astype(np.float32)


TOP = 2


def subtrees(keys: np.ndarray, depth: int) -> list[slice]:
    """Where sorted keys of one context of depth TOP have the same context of depth TOP + 1: what is weighted at a time."""
    own = keys >> np.uint64(8 * (depth - TOP))
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return [slice(int(i), int(j)) for i, j in zip(first, np.append(first[1:], len(keys)), strict=True)]


def summary(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Context, log weighted probabilities and byte counts of one context of depth TOP; its subtrees are weighted one after the other."""
    leaves, children = np.zeros((1, 256), np.int64), None
    for part in subtrees(keys, depth):
        if depth == TOP:
            leaves += weighted(keys[part], counts[part], depth, TOP)[0].leaves
        else:
            top = weighted(keys[part], counts[part], depth, TOP + 1)[0]
            leaves += top.leaves
            children = top.log_pw if children is None else children + top.log_pw
    log_pe, _ = kt(node_counts(leaves))
    log_pw = log_pe if children is None else np.logaddexp(log_pe, children) - LOG2
    return int(keys[0] >> np.uint64(8 * (depth - TOP + 1))), log_pw[0], leaves[0]


def below(log_pw: np.ndarray, leaves: np.ndarray, sure: np.ndarray, left: np.ndarray, is_leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """sure and left below contexts of depth TOP, from their summaries and the same of the level above, by row."""
    log_pe, p1 = kt(node_counts(leaves))
    stop = np.ones_like(p1) if is_leaf else np.exp(log_pe - LOG2 - log_pw)
    return sure + left * stop * p1, left * (1 - stop)


def upper_levels(contexts: np.ndarray, log_pw: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """From all groups' summaries: sorted last bytes, sure and left below each, and rows (depth, context, log chances) of depths 0 and 1."""
    order = np.argsort(contexts)
    contexts, log_pw, leaves = contexts[order], log_pw[order], leaves[order]
    levels = []
    for _ in range(2):
        upper, parent = np.unique(contexts >> 8, return_inverse=True)
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        children, leaves, contexts = np.add.reduceat(log_pw, first, axis=0), np.add.reduceat(leaves, first, axis=0), upper
        log_pe, p1 = kt(node_counts(leaves))
        log_pw = np.logaddexp(log_pe, children) - LOG2
        levels.append(Level(contexts, np.zeros(len(contexts), np.int64), p1, np.exp(log_pe - LOG2 - log_pw), log_pw, leaves))
    one, root = levels
    sure, left = mixed(root, np.zeros((1, 256)), np.ones((1, 256)))
    rows = [(0, 0, log_chances(sure, left)[0])]
    sure, left = mixed(one, np.repeat(sure, len(one.contexts), 0), np.repeat(left, len(one.contexts), 0))
    rows += [(1, int(c), x) for c, x in zip(one.contexts, log_chances(sure, left), strict=True)]
    return one.contexts, sure, left, rows


def slice_of(pairs: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the table that a context of depth TOP and all deeper ones ending with it are in."""
    return (pairs.astype(np.int64) * 40503 % 65536) * slices // 65536


def train(docs: DataFrame, depth: int = DEPTH, model_bytes: int = MODEL_BYTES) -> tuple[str, int]:
    """The path of the model table, in the shared folder, and the number of its slices, none of which needs more than about model_bytes in a worker.

    Columns: slice, depth, context, log_chances (of the bytes seen in training, at depth 0 of all 256; at depth -1 those bytes). Contexts of depths 0 and 1 are in slice -1.
    """
    spark = docs.sparkSession
    counts = cut(context_counts(docs, depth), "contexts").withColumn("last", F.shiftrightunsigned("key", 8 * (depth - TOP + 1)))

    def summarised(table: pa.Table) -> pa.Table:
        context, log_pw, leaves = summary(*_sorted(table), depth)
        return pa.table({"last": pa.array([context], pa.int64()), "log_pw": pa.array([log_pw.tobytes()], pa.binary()), "leaves": pa.array([leaves.tobytes()], pa.binary())})

    tops = cut(counts.groupBy("last").applyInArrow(summarised, "last long, log_pw binary, leaves binary"), "context-tops")
    rows = tops.collect()
    path = scratch(spark, "ctw-model")
    model = "slice int, depth int, context long, log_chances binary"
    if not rows:
        flat = np.full(256, -math.log10(256), np.float32).tobytes()
        spark.createDataFrame([(-1, 0, 0, bytearray(flat)), (-1, -1, 0, bytearray(range(256)))], model).write.partitionBy("slice").parquet(path)
        return path, 1
    matrix = lambda i, kind: np.stack([np.frombuffer(r[i], kind) for r in rows])
    seen = np.flatnonzero(sum(np.frombuffer(r[2], np.int64) for r in rows))
    last, sure, left, top_rows = upper_levels(np.array([r[0] for r in rows], np.int64), matrix(1, np.float64), matrix(2, np.int64))
    del rows
    above = {int(c): i for i, c in enumerate(last)}
    slices = max(1, math.ceil(counts.count() * CONTEXTS_PER_COUNT * len(seen) * CELL_BYTES / model_bytes))

    def tabled(key: tuple, table: pa.Table, top: pa.Table) -> pa.Table:
        keys, n = _sorted(table)
        pair = key[0].as_py()
        i = above[pair >> 8]
        s, rest = below(np.frombuffer(top["log_pw"][0].as_py())[None], np.frombuffer(top["leaves"][0].as_py(), np.int64)[None], sure[i : i + 1], left[i : i + 1], depth == TOP)
        out: dict[str, list] = {"depth": [TOP], "context": [pair], "log_chances": [log_chances(s, rest)[0, seen].tobytes()]}
        for part in subtrees(keys, depth) if depth > TOP else []:
            a, b = s, rest
            for d, level in enumerate(weighted(keys[part], n[part], depth, TOP + 1), TOP + 1):
                a, b = mixed(level, *((a, b) if d == TOP + 1 else (a[level.parent], b[level.parent])))
                out["depth"] += [d] * len(level.contexts)
                out["context"] += level.contexts.astype(np.int64).tolist()
                out["log_chances"] += [x.tobytes() for x in log_chances(a, b)[:, seen]]
        release()
        number = int(slice_of(np.array([pair]), slices)[0])
        return pa.table({"slice": pa.array([number] * len(out["depth"]), pa.int32()), "depth": pa.array(out["depth"], pa.int32()), "context": pa.array(out["context"], pa.int64()), "log_chances": pa.array(out["log_chances"], pa.binary())})

    upper = [(-1, d, c, bytearray((x if d == 0 else x[seen]).tobytes())) for d, c, x in top_rows] + [(-1, -1, 0, bytearray(seen.astype(np.uint8).tobytes()))]
    made = counts.groupBy("last").cogroup(tops.groupBy("last")).applyInArrow(tabled, model)
    made.unionByName(spark.createDataFrame(upper, model)).write.partitionBy("slice").parquet(path)
    return path, slices


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


# ---- scoring ----


class Model:
    """The table as arrays: a walk from the latest byte backwards finds the deepest seen context of every position at once."""

    def __init__(self, seen: np.ndarray, root: np.ndarray, contexts: list[np.ndarray], chances: np.ndarray) -> None:
        """seen: the bytes of training; root: log chances of all bytes without context; contexts: by depth from 0, sorted; chances: of seen bytes, a row for each context."""
        self.depth, self.root, self.chances = len(contexts) - 1, root.astype(np.float64), chances
        self.n = len(seen) + 1
        self.symbol = np.full(256, self.n - 1, np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in contexts])])
        self.steps = []
        for d in range(1, self.depth + 1):
            before, here = contexts[d - 1], contexts[d]
            step = np.full((len(before) + 1) * self.n, len(here), np.int32)  # the last state of a level: not seen
            step[np.searchsorted(before, here >> 8) * self.n + self.symbol[here & 255]] = np.arange(len(here))
            self.steps.append(step)

    def __call__(self, texts: list[str | None], number: int = 0, slices: int = 1) -> np.ndarray:
        """The log10 probability of each text; of several slices, this one's part of it."""
        stream, at, text = byte_stream(texts, max(self.depth, TOP))
        if slices > 1:
            pairs = (stream[at - 1].astype(np.int64) << 8) | stream[at - 2]
            own = slice_of(pairs, slices) == number
            at, text = at[own], text[own]
        symbols = self.symbol[stream]
        state, row = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for d, step in enumerate(self.steps, 1):
            state = step[state * self.n + symbols[at - d]]
            row = np.where(state < self.base[d + 1] - self.base[d], np.int32(self.base[d]) + state, row)
        own = symbols[at]
        known = own < self.n - 1
        logs = np.where(known, self.chances[row, np.minimum(own, self.n - 2)].astype(np.float64), self.root[stream[at]])
        return np.bincount(text, weights=logs, minlength=len(texts))


_LOADED: dict[tuple[str, int], Model] = {}


def load(path: str, number: int = 0) -> Model:
    """A slice of a path's model, read once by a worker, batch by batch into one array; the worker keeps one slice at a time."""
    if (path, number) not in _LOADED:
        import pyarrow.dataset as ds
        from pyarrow import fs

        _LOADED.clear()
        release()
        files, root = fs.FileSystem.from_uri(path)
        folders = [f"{root}/slice={k}" for k in (-1, number)]
        found = [f.path for d in folders if files.get_file_info(d).type == fs.FileType.Directory for f in files.get_file_info(fs.FileSelector(d)) if f.base_name.endswith(".parquet")]
        data = ds.dataset(found, filesystem=files, format="parquet")
        narrow = data.to_table(columns=["depth", "context"])
        depths, contexts = narrow["depth"].to_numpy(), narrow["context"].to_numpy()
        order = np.lexsort((contexts, depths))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        own = {r["depth"]: r["log_chances"] for r in data.to_table(filter=ds.field("depth") < 1).to_pylist()}
        seen = np.frombuffer(own[-1], np.uint8)
        chances, at = np.zeros((len(order) - 1, len(seen)), np.float16), 0  # half precision halves what a worker holds
        for b in data.scanner(columns=["depth", "log_chances"], batch_size=20_000, use_threads=False, batch_readahead=1, fragment_readahead=1).to_batches():
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d >= 0:
                    v = np.frombuffer(x, np.float32)
                    chances[place[at] - 1] = v[seen] if d == 0 else v
                at += 1
        depths, contexts = depths[order][1:], contexts[order][1:]
        _LOADED[path, number] = Model(seen, np.frombuffer(own[0], np.float32), [contexts[depths == d] for d in range(int(depths.max()) + 1)], chances)
    return _LOADED[path, number]


def model_scores(docs: DataFrame, path: str, slices: int, *keys: str) -> DataFrame:
    """keys, slice and score: what each slice of the model adds to the log10 probability of each text with its end. Each pass over the texts holds one slice. Other columns are not read."""
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keys) + ", slice int, score double"

    def of(number: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, 1 << 20):
                scores = load(path, number)(b.column(len(keys)).to_pylist(), number, slices)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array([number] * b.num_rows, pa.int32()), pa.array(scores, pa.float64())], [*keys, "slice", "score"])
            release()

        return docs.select(*keys, "text").mapInArrow(run, schema)

    out = of(0)
    for number in range(1, slices):
        out = out.unionByName(of(number))
    return out


def token_hashes(text: Column) -> Column:
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def scored(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row. Training uses the rows that are not held out."""
    out = (crc_of_id(F.col("doc_id")) % 5 == 1) if held_out is None else held_out
    rows = docs.select(F.col("doc_id"), "text", F.coalesce(out, F.lit(False)).alias("held_out"))
    train_rows = rows.filter(~F.col("held_out"))
    path, slices = train(train_rows, depth, model_bytes)

    counts = cut(train_rows.select(F.explode(token_hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("c")), "words")
    sizes = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("k")).collect()
    ends = train_rows.count()
    total, distinct = sum(r["c"] for r in sizes) + ends, sum(r["n"] for r in sizes) + (ends > 0)
    hot, low = 0, 64
    for r in sizes:
        if hot + r["n"] > HOT_WORDS:
            break
        hot, low = hot + r["n"], r["k"]
    over = math.log10(total + 0.5 * (distinct + 1))
    often = counts.filter(F.col("c") >= (1 << low) if low < 64 else F.lit(False)).select("h", "c")
    keyed = rows.select("doc_id", F.xxhash64("text").alias("t"), "held_out", "text")
    tokens = keyed.select("doc_id", "t", F.explode(token_hashes(F.col("text"))).alias("h")).join(F.broadcast(often), "h", "left")
    rare = F.when(F.col("c").isNull(), F.col("h"))
    part = tokens.groupBy("doc_id", "t", rare.alias("h")).agg(F.count("*").alias("n"), F.count("c").alias("known"), F.coalesce(F.sum(F.log10(F.col("c") + 0.5)), F.lit(0.0)).alias("logs"))
    of_rare = part.join(counts.filter(F.col("c") < (1 << low)) if low < 64 else counts, "h", "left")
    of_words = of_rare.select(
        "doc_id", "t", "n",
        F.when(F.col("h").isNull(), F.col("known")).when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"),
        F.when(F.col("h").isNull(), F.col("logs")).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).alias("row"),
    )
    end = F.lit(math.log10(ends + 0.5))
    first = F.col("slice") == 0  # the row of the text itself; other slices only add to its score
    once = lambda value: F.when(first, value).otherwise(F.lit(0))
    of_rows = model_scores(keyed, path, slices, "doc_id", "t", "held_out").select(
        "doc_id", "t", once(F.lit(1)).alias("n"), once(F.lit(int(ends > 0))).alias("known"), once(end).alias("logs"), "score", "held_out", once(F.lit(1)).alias("row")
    )
    summed = of_words.unionByName(of_rows).groupBy("doc_id", "t").agg(
        *[F.sum(c).alias(c) for c in ("n", "known", "logs", "row", "score")], F.max("held_out").alias("held_out")
    )
    n = (F.col("n") / F.col("row")).cast("long")
    return summed.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("known") / F.col("row")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("row") - n * F.lit(over)).alias("base_score"), (F.col("score") / F.col("row")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("row").cast("int"))).alias("copy"),
    ).drop("copy")
