"""Removal of byte strings of `length` that also start elsewhere, by column-wise construction of collections' Burrows-Wheeler transforms and common prefixes.

Strings meet first. Every string of `length` bytes has an anchor: of its grams of length - WINDOW + 1 bytes the one with the least hash, the last of equal ones. Equal strings have equal anchors at
equal places, so only strings with the same anchor can be equal. The starts of a text that share an anchor make a segment (at most length + WINDOW - 1 bytes). Equal segments are one, with a
number of copies; a segment with copies repeats as a whole, one whose anchor no other has repeats nowhere, and the others, of all texts, are the collection, less those starts whose strings' common core no
other segment of the anchor has (`trimmed`).

Column-wise construction (`shared_starts`). The suffixes of all segments are sorted without comparing them: round t inserts, for every segment of t or more bytes, the symbol before its suffix of t - 1
bytes. Suffixes of one first symbol are in the order of what follows it, so a new one's place comes from the places of its symbol in the transform, and its common prefixes from the least values
between two of them. A start repeats if its suffix shares `length` bytes with a neighbour. A task streams its anchors' segments in order and works on a bounded batch
of about BATCH bytes, whole anchors together; the transform and the prefixes of a batch are arrays that are rewritten front to back each round, not files, as a batch is below a megabyte.

Hot anchors (more than LIMIT different segments, as where a passage that many texts hold ends in each another way) are halved: by the starts' distance from the anchor, each half meeting by a hash of all bytes that its
strings share, until a group is small; at distance one the strings of a group are equal. So no group is unbounded and no case is left out.

At scale. Texts are shuffled once, to keep one of equal ones (stored in buckets by hash, which later joins use without another exchange); anchors are counted first and a bitmap of the repeated ones, of BITS bits at most,
keeps the others out of every later shuffle (a false hit is dropped by exact counts). Removed runs and hashes are made once for each different text.

Defined cases: a null text is empty; texts shorter than length lose nothing. Repeated rows and equal texts repeat each other. Empty tables give no rows. Other columns are kept but for those named
like results, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import cut, release, scratch, text_slices

LENGTH, WINDOW = 400, 192
#: Bytes that a task looks for anchors in at once, bytes of a batch, most different segments of an anchor that are not halved, most bits of the bitmap, distances from an anchor that are looked at together before the transform.
PIECE, BATCH, LIMIT, BITS, STEP = 500_000, 1 << 17, 512, 1 << 30, 32
_PLACE, _LOW = (1 << 20) - 1, (1 << 32) - 1
_ODD = 0x9E3779B97F4A7C15
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
SEGMENT = "r binary, m long, key long, mark binary, start long, starts int, lead int"
OPEN = "pkey long, pmark binary, base int, starts int, n long, key long, mark binary, lead int, lo int, hi int, bytes binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(data: bytes, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray], length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings joined as data, each ending before one of ends: first start, number of starts, distance of the anchor from the first start, and hash of the anchor, of all segments."""
    gram, n = length - window + 1, len(data)
    begins = np.concatenate([[0], ends[:-1]])
    number = np.maximum(ends - begins - length + 1, 0)
    if not number.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    up, down = powers
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[np.frombuffer(data, np.uint8)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n])])
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least, width = h & np.uint64(~_PLACE & 0xFFFFFFFFFFFFFFFF) | np.uint64(_PLACE) - np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    anchor = _PLACE - (least & np.uint64(_PLACE)).astype(np.int64)
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    own = anchor[starts]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    return starts[first], np.diff(np.concatenate([first, [len(starts)]])), own[first] - starts[first], h[own[first]]


def _mark(content: bytes, lead: int) -> bytes:
    return hashlib.blake2b(content, digest_size=16, salt=lead.to_bytes(8, "little")).digest()


def _pieces(texts: DataFrame, bitmap: np.ndarray | None, length: int, window: int) -> DataFrame:
    """texts (r, m, text as bytes): keys and m of all segments, or whole segments (see SEGMENT) of those whose anchors the bitmap has."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers = shared.value, _powers(2 * PIECE + length)

        def out(waiting: list[tuple[bytes, int, int, bytes]]) -> pa.RecordBatch:
            data = b"".join(x[3] for x in waiting)
            ends = np.cumsum([len(x[3]) for x in waiting])
            start, starts, lead, key = segments(data, ends, powers, length, window)
            of = np.searchsorted(ends, start, side="right")
            m = np.array([x[1] for x in waiting], np.int64)
            if known is None:
                keys, back = np.unique(key.view(np.int64), return_inverse=True)
                return pa.RecordBatch.from_pydict({"key": keys, "m": np.bincount(back, m[of], len(keys)).astype(np.int64)})
            slot = key % np.uint64(len(known) * 64)
            here = np.flatnonzero(known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            start, starts, lead, key, of = start[here], starts[here], lead[here], key[here], of[here]
            marks = [_mark(data[s : s + k - 1 + length], d) for s, k, d in zip(start.tolist(), starts.tolist(), lead.tolist(), strict=True)]
            offset = start + np.array([x[2] for x in waiting])[of] - np.concatenate([[0], ends[:-1]])[of]
            columns = [pa.array([waiting[i][0] for i in of], pa.binary()), pa.array(m[of]), pa.array(key.view(np.int64)), pa.array(marks, pa.binary()), pa.array(offset), pa.array(starts.astype(np.int32)), pa.array(lead.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["r", "m", "key", "mark", "start", "starts", "lead"])

        waiting, size = [], 0
        for b in text_slices(batches, PIECE):
            for r, m, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(0, max(len(text) - length + 1, 0), PIECE):
                    waiting.append((r, m, at, text[at : at + PIECE + length - 1]))
                    size += len(waiting[-1][3])
                    if size >= PIECE:
                        yield out(waiting)
                        waiting, size = [], 0
        if waiting:
            yield out(waiting)
        release()

    return texts.select("r", "m", "text").mapInArrow(run, "key long, m long" if bitmap is None else SEGMENT)


def bitmap_of(keys: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of keys, 16 bits or more for each up to BITS."""
    bits = 1 << min(max(rows * 16, 1 << 16).bit_length(), BITS.bit_length() - 1)
    slot = F.col("key").bitwiseAND(bits - 1)
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & {63} as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def shared_starts(strings: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its first starts[i] suffixes share length bytes with another suffix of the collection."""
    m, sizes = len(strings), np.array([len(s) for s in strings])
    joined, base = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = np.zeros(256, np.uint8)
    used = np.unique(joined)
    code[used] = np.arange(1, len(used) + 1)  # UTF-8 never has all 256 values, so 0 is free for the end
    symbols = code[joined]
    bwt, lcp = symbols[base + sizes - 1], np.zeros(m + 1, np.int16)
    # of each suffix but the empty ones, in order: its first symbol and, in the lower 32 bits, the place of what follows it; and how many there are of each first symbol
    tail, count = np.zeros(0, np.int64), np.zeros(257, np.int64)
    # places of the latest suffixes of the strings that go on, in order, and which these strings are
    places, which, full = np.arange(m), np.arange(m), np.zeros(m, np.int64)
    for t in range(1, int(sizes.max()) + 1):
        n, new = len(bwt), len(places)
        by = np.argsort(bwt[places], kind="stable")
        first, old, which = bwt[places][by], places[by], which[by]
        own = first.astype(np.int64) << 32 | old
        k = tail.searchsorted(own)
        at = k + np.arange(new)  # of the new suffixes, among those but the empty ones
        fresh = np.zeros(n + new + 1, bool)
        fresh[m + at] = True
        rest = ~fresh[:-1]
        merged = np.empty(len(tail) + new, np.int64)
        merged[rest[m:]], merged[at] = tail, own
        count += np.bincount(first, minlength=257)
        begin = np.cumsum(count) - count
        # common prefixes with the one before, of new suffixes and of old ones after them, by the least of those between what follows their first symbols
        touched = np.concatenate([at[at > begin[first]], at[(at + 1 < begin[first] + count[first]) & ~fresh[m + at + 1]] + 1])
        touched = touched[np.argsort(-(merged[touched - 1] & _LOW))]  # from the right, so that nothing between two ranges is looked at
        grown_lcp = np.zeros(n + new + 1, np.int16)
        grown_lcp[:-1][rest] = lcp[:-1]
        if len(touched):
            grown_lcp[m + touched] = np.minimum.reduceat(lcp, np.column_stack([merged[touched - 1] + 1 & _LOW, merged[touched] + 1 & _LOW]).ravel())[::2] + 1
        done = sizes[which] == t
        grown = np.empty(n + new, np.uint8)
        grown[rest] = bwt
        grown[m + at] = np.where(done, 0, symbols[base[which] + np.maximum(sizes[which] - t - 1, 0)])
        moved = np.repeat(np.arange(new + 1, dtype=np.int32), np.diff(np.concatenate([[0], m + k, [n]])))
        tail = merged + moved.take(merged & _LOW, mode="clip")
        bwt, lcp = grown, grown_lcp
        full[full > 0] += moved[full[full > 0] - 1]  # places of whole strings, from 1
        full[which[done]] = m + at[done] + 1
        places, which = m + at[~done], which[~done]
        if not len(places):
            break
    shared = np.maximum(lcp[:-1], lcp[1:]) >= length
    place, out = full - 1, np.zeros((m, int(starts.max())), bool)
    for i in range(out.shape[1]):
        live = starts > i
        out[live, i] = shared[place[live]]
        place[live] = tail[place[live] - m] & _LOW
    return [row[:s] for row, s in zip(out, starts, strict=True)]


def trimmed(group: list[tuple], length: int) -> list[tuple]:
    """Different segments of one anchor (pkey, pmark, base, starts, key, lead, bytes), cut down to where they can repeat each other: from the first to the last of their steps of STEP distances whose core,
    the bytes that all strings of the step share, another segment has too. Rows of pkey, pmark, base, starts, key, bytes; a segment without such a step is left out, as none of its strings has an equal one."""
    met: dict[tuple[int, bytes], int] = {}
    cores = []
    for *_, starts, _, lead, content in group:
        own = [(at, content[lead - at : max(lead - at - STEP + 1 + length, 0)]) for at in range((lead - starts + 1) // STEP * STEP, lead + 1, STEP)]
        cores.append(own)
        for c in own:
            met[c] = met.get(c, 0) + 1
    out = []
    for (pkey, pmark, base, starts, key, lead, content), own in zip(group, cores, strict=True):
        if held := [at for at, core in own if met[at, core] > 1]:
            i, j = max(lead - held[-1] - STEP + 1, 0), min(lead - held[0] + 1, starts)
            out.append((pkey, pmark, base + i, j - i, key, content[i : j - 1 + length]))
    return out


def _columns(rows: DataFrame, limit: int, length: int) -> DataFrame:
    """rows (see OPEN, whole groups of equal key, none of over limit rows): pkey, pmark, first, past of repeated starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = shared_starts([x[5] for x in rows], np.array([x[3] for x in rows]), length)
            made = [(x[0], x[1], x[2] + int(a), x[2] + int(b)) for x, hit in zip(rows, found, strict=True) for a, b in np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)]
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, types, strict=True)], ["pkey", "pmark", "first", "past"])

        waiting, size = [], 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, lambda row: row[4]):
            if size >= BATCH:
                yield out(waiting)
                waiting, size = [], 0
            kept = trimmed(list(group), length)
            waiting += kept
            size += sum(len(row[5]) for row in kept)
        if waiting:
            yield out(waiting)
        release()

    near = rows.select("pkey", "pmark", "base", "starts", "key", "lead", "bytes").repartition("key").sortWithinPartitions("key")
    return near.mapInArrow(run, "pkey long, pmark binary, first int, past int")


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Rows of OPEN cut in two by the distance of their starts from the anchor."""
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in OPEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for pkey, pmark, base, starts, n, key, _, lead, lo, hi, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mid = (lo + hi) // 2
                turn = min(max(lead - mid + 1, 0), starts)
                for i, j, low, high in ((0, turn, mid, hi), (turn, starts, lo, mid)):
                    if i < j:
                        d = lead - i
                        part = content[i : j - 1 + length]
                        common = content[lead - low : lead - (high - 1) + length]
                        own = struct.unpack("<q", hashlib.blake2b(common, digest_size=8, salt=struct.pack("<qii", key, low, high)).digest())[0]
                        made.append((pkey, pmark, base + i, j - i, n, own, _mark(part, d), d, low, high, part))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    return rows.select(*names).mapInArrow(run, OPEN)


def repeated(texts: DataFrame, length: int = LENGTH, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """texts (r, one row each; m, how often the text occurs; text as bytes): r, first, past of starts of strings that also start elsewhere. A run of starts may come in several rows."""
    counted = cut(_pieces(texts, None, length, window).groupBy("key").agg(F.sum("m").alias("m")).filter("m > 1").select("key"), "repeats-keys")
    found = cut(_pieces(texts, bitmap_of(counted, counted.count()), length, window), "repeats-segments")
    one = found.groupBy("key", "mark").agg(F.sum("m").alias("n"), F.min(F.struct("r", "start")).alias("at"), F.max("starts").alias("starts"), F.max("lead").alias("lead"))
    one = cut(one.select("key", "mark", "n", "at.*", "starts", "lead"), "repeats-distinct")
    groups = one.groupBy("key").agg(F.count("*").alias("distinct")).filter("distinct > 1")
    told = one.filter("n > 1").select(F.col("key").alias("pkey"), F.col("mark").alias("pmark"), F.lit(0).alias("first"), F.col("starts").alias("past"))
    wanted = one.join(groups, "key").groupBy("r").agg(F.collect_list(F.struct("key", "mark", "n", "start", "starts", "lead", "distinct")).alias("parts"))
    opened = wanted.join(texts.select("r", "text"), "r").select("text", F.explode("parts").alias("p")).select(
        F.col("p.key").alias("pkey"), F.col("p.mark").alias("pmark"), F.lit(0).alias("base"), "p.starts", "p.n", "p.key", "p.mark", "p.lead", F.lit(0).alias("lo"), F.lit(window).alias("hi"),
        F.expr(f"substring(text, cast(p.start + 1 as int), p.starts + {length - 1})").alias("bytes"), "p.distinct",
    )
    opened = cut(opened, "repeats-open")
    made = [told]
    while True:
        made.append(cut(_columns(opened.filter(F.col("distinct") <= limit), limit, length), "repeats-starts"))
        hot = opened.filter(F.col("distinct") > limit)
        if hot.isEmpty():
            break
        halves = cut(_halved(hot, length), "repeats-halves")
        marks = cut(halves.groupBy("key", "mark").agg(F.sum("n").alias("all")), "repeats-marks")
        made.append(halves.join(marks.filter("all > 1"), ["key", "mark"]).select("pkey", "pmark", F.col("base").alias("first"), F.expr("base + starts").alias("past")))
        groups = marks.groupBy("key").agg(F.count("*").alias("distinct")).filter("distinct > 1")
        opened = cut(halves.dropDuplicates(["key", "mark"]).join(groups, "key"), "repeats-open")
    union = made[0]
    for more in made[1:]:
        union = union.union(more)
    here = found.select("r", F.col("key").alias("pkey"), F.col("mark").alias("pmark"), "start")
    return here.join(union, ["pkey", "pmark"]).select("r", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("past")).alias("past"))


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """texts (r, text, runs of starts): r, spans of removed bytes, kept bytes."""
    fields = pa.schema([("r", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            out = []
            for r, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans: list[dict[str, int]] = []
                for x in sorted(runs or [], key=lambda x: x["first"]):
                    first, past = x["first"], x["past"] + length - 1
                    if spans and first <= spans[-1]["past"]:
                        spans[-1]["past"] = max(past, spans[-1]["past"])
                    else:
                        spans.append({"first": first, "past": past})
                cuts = [0, *(v for s in spans for v in (s["first"], s["past"])), len(text)]
                out.append((r, len(text), spans, b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return texts.mapInArrow(run, "r binary, n_bytes long, spans array<struct<first: bigint, past: bigint>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    spark = docs.sparkSession
    own = docs.drop(*RESULTS).withColumn("_r", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    name = f"texts_{uuid.uuid4().hex}"
    distinct = own.select(F.col("_r").alias("r"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).groupBy("r").agg(F.count("*").alias("m"), F.first("text").alias("text"))
    distinct.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "r").option("path", scratch(spark, "repeats-texts")).saveAsTable(name)
    texts = spark.table(name)
    runs = repeated(texts, length, window, limit).groupBy("r").agg(F.collect_set(F.struct("first", "past")).alias("runs"))
    kept = _kept(texts.join(runs, "r", "left").select("r", "text", "runs"), length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    told = cut(kept.select("r", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "repeats-told")
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay in the shared folder
    told = told.withColumnRenamed("r", "_told")
    return own.join(told, F.col("_r") == F.col("_told")).drop("_r", "_told")
