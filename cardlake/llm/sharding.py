"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters meet a tolerance, then one exchange.

Law `bytes`: every shard holds nearly the same number of bytes. A document's key is 40 bits of its text's hash followed by 24 bits of a hash
of its id: equal texts are neighbours and so share a shard, unless a boundary has to cut a group that is too large for the tolerance.
Each pass counts, in every partition, the rows and bytes between neighbouring probes (a fixed number of counters per task), sums them, and
narrows the bracket around each target by a factor of PROBES + 1. Splitters are found for CELLS cells per shard at once, so that the final exchange and
the sort within it are spread evenly over more tasks than there are shards; the last histogram also gives each cell's exact row count, so
that slots are gapless without a global window.

Defined cases: a null text has no bytes and size 8. Null and repeated ids are kept; identical rows have equal keys and stay together. Empty
tables give an empty result. Input columns named like result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.llm.common import cut

PROBES, TOLERANCE, OVERHEAD = 15, 0.002, 8
CELL_BYTES = 256 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """docs with size and _key."""
    of_text, of_id = F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), F.col("doc_id").cast("string"))
    key = of_text.bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(of_id.bitwiseAND(F.lit((1 << 24) - 1)))
    return docs.withColumns({"size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + OVERHEAD, "_key": key})


def histogram(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes in each of the len(probes) + 1 intervals between sorted probes; a key equal to a probe is at or above it."""
    n = len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(zero_copy_only=False), side="right")
            rows += np.bincount(at, minlength=n)
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
        there = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(rows[there]), pa.array(size[there])], ["cell", "rows", "bytes"])

    summed = keys.select("_key", "size").mapInArrow(count, "cell long, rows long, bytes long").groupBy("cell").agg(F.sum("rows"), F.sum("bytes")).collect()
    rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for cell, r, b in summed:
        rows[cell], size[cell] = r, b
    return rows, size


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int]]:
    """parts - 1 keys that cut the bytes into near equal parts, and the rows of each part.

    Each target keeps the best key seen and a bracket of keys around the target; probing ends when every target is within tolerance of a part's bytes, or
    when a bracket holds no further key.
    """
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    targets = [total * k // parts for k in range(1, parts)]
    best = [(total + 1, HIGH)] * len(targets)
    brackets = [(LOW, HIGH)] * len(targets)
    probes = sorted({LOW + (2 * HIGH + 1) * k // (parts * 4) for k in range(1, parts * 4)})
    while probes:
        _, size = histogram(keys, np.array(probes, np.int64))
        below = np.cumsum(size)[:-1]
        wanted: set[int] = set()
        for t, target in enumerate(targets):
            at = int(np.searchsorted(below, target))  # below[at - 1] < target <= below[at]
            for i in (at - 1, at):
                if 0 <= i < len(probes):
                    best[t] = min(best[t], (abs(int(below[i]) - target), probes[i]))
            lo, hi = brackets[t]
            lo, hi = max(lo, probes[at - 1] if at else LOW), min(hi, probes[at] if at < len(probes) else HIGH)
            brackets[t] = (lo, hi)
            if best[t][0] > tolerance * total / parts and hi - lo > 1:
                wanted |= {lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {lo, hi}
        probes = sorted(wanted)
    cuts = sorted(k for _, k in best)
    rows, _ = histogram(keys, np.array(cuts, np.int64))
    return cuts, rows.tolist()


def shard(docs: DataFrame, shards: int = 24, cells: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, shard and slot (gapless from 0 within its shard, in key order).

    cells: cells per shard; by default as many as spread the exchange over spark.sql.shuffle.partitions, and more where one would exceed CELL_BYTES.
    """
    spark = docs.sparkSession
    narrow = cut(keyed(docs).select("_key", "size"), "shard-keys")
    if not cells:
        total = narrow.agg(F.sum("size")).first()[0] or 0
        cells = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards), -(-total // (shards * CELL_BYTES)))
    cuts, rows = splitters(narrow, shards * cells, tolerance * cells if cells < 8 else tolerance * 8)
    starts = np.concatenate([[0], np.cumsum(rows)])[:-1]
    offsets = [int(starts[c] - starts[c - c % cells]) for c in range(shards * cells)]
    own = docs.drop("size", "shard", "slot")
    placed = keyed(own).withColumn("_cell", _interval(F.col("_key"), cuts))
    spread = placed.repartitionById(len(rows), "_cell")  # each cell in a task of its own, where a hash would put some together
    order = Window.partitionBy("_cell").orderBy("_key", "doc_id")
    return (
        spread.withColumns({"shard": F.floor(F.col("_cell") / cells).cast("int"), "slot": F.row_number().over(order) - 1 + F.element_at(F.lit(offsets), F.col("_cell") + 1).cast("long")})
        .drop("_cell", "_key")
    )


def _interval(key, cuts: list[int]):
    """The number of cuts at or below key, by a nest of comparisons as deep as the logarithm of their number."""
    def node(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(cuts))
