"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents, in DataFrame expressions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is WINDOW consecutive words of a benchmark item, or
the whole item if it has fewer (but some). A window is seen as the set of its shingles (SHINGLE words, or all words of a shorter window) with
their positions. Exact containment needs every shingle, so a prefix of one shingle suffices for candidates: the rarest in the corpus. The
join is on that shingle; length and position must leave room for the whole window; then the window-sized slice of the document is compared
word by word, inside the same generated code, so that a candidate that fails is never stored.

The prefix table grows with the benchmark, not with the corpus. It is broadcast only if its counted size is below BROADCAST_WINDOWS rows; otherwise shingles and
windows meet by a shuffle of rows without words (adaptive execution splits a shingle that many documents hold), and the candidates are compared after they
have been brought back to their document's text. Results are the same. Frequencies of shingles are taken over all documents.

Defined cases: a null text or one without words has no words and no hits; so has an item. Several items may hold the same window: each counts. An item without an id has hits, but is not among the items.
Results are joined back on the document's id and text, null-safe, so repeated rows keep one result row each. Empty tables on
either side give no hits. Input columns named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import ascii_lower, let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 3
BROADCAST_WINDOWS = 500_000


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(ws: Column, size: int) -> Column:
    """Hashes of every run of size words, by position."""
    n = F.size(ws) - (size - 1)
    parts = lambda i: [ws[i + k] for k in range(size)]
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.lit(size), *parts(i)))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window (its words), size: each distinct window of each item."""
    ws = benchmark.select("item_id", item_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    return ws.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("window")).distinct().withColumn("size", F.size("window"))


def _document_shingles(docs: DataFrame, sizes: list[int], *carried: str) -> DataFrame:
    """carried columns (of docs, or ws, or n_ws, its size), pos and h for each shingle of each document."""
    keys = [F.col(c) for c in carried if c not in ("ws", "n_ws")]
    of_words = lambda ws: F.struct(ws.alias("ws"), F.size(ws).alias("n_ws"), *[shingles(ws, k).alias(f"s{k}") for k in sizes])
    hashed = docs.select(*keys, let(item_words(F.col("text")), of_words).alias("d"))
    parts = [hashed.select(*keys, *[F.col(f"d.{c}").alias(c) for c in ("ws", "n_ws") if c in carried], F.posexplode(f"d.s{k}").alias("pos", "h")) for k in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_hash, item_id, start, size: each occurrence of a benchmark window in a document."""
    spark = docs.sparkSession
    found = windows(benchmark, window).withColumn("k", F.least("size", F.lit(SHINGLE)))
    n, *sizes = found.agg(F.count("*"), *[F.max((F.col("k") == k).cast("int")) for k in range(1, SHINGLE + 1)]).first()
    sizes = [k for k, there in zip(range(1, SHINGLE + 1), sizes, strict=True) if there]
    if not n:
        return spark.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, start int, size int")
    few = n <= broadcast_windows
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    shingled = F.lit(None)
    for k in sizes:
        shingled = F.when(F.col("k") == k, shingles(F.col("window"), k)).otherwise(shingled)
    tokens = found.select("item_id", "window", "size", F.posexplode(shingled).alias("off", "h"))
    # rarity: occurrences over all documents of the shingles that windows have
    seen = _document_shingles(docs, sizes, "doc_id").join(small(tokens.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.count("*").alias("seen"))
    # a shingle that no document has rules its windows out
    rarest = (
        tokens.join(seen, "h", "left")
        .groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("off"), F.col("h"))).alias("p"), F.collect_set("item_id").alias("items"))
        .filter("p.seen > 0")
    )
    # equal windows of several items are looked up once
    prefix = rarest.select("window", "size", F.col("p.off").alias("off"), F.col("p.h").alias("h"), "items")
    text_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    start = F.col("pos") - F.col("off")
    room = lambda n_ws: (start >= 0) & (start + F.col("size") <= n_ws)
    same = lambda ws, c: F.slice(ws, c["start"] + 1, c["size"]) == c["window"]
    if few:
        at = _document_shingles(text_docs, sizes, "doc_id", "text_hash", "ws").join(small(prefix), "h").filter(room(F.size("ws")))
        at = at.filter(F.slice("ws", start + 1, F.col("size")) == F.col("window")).select("doc_id", "text_hash", start.alias("start"), "size", "items")
    else:
        # words stay out of the shuffle on shingles; each document's candidates meet its text once
        candidates = _document_shingles(text_docs, sizes, "doc_id", "text_hash", "n_ws").join(prefix, "h").filter(room(F.col("n_ws")))
        of_doc = candidates.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct(start.alias("start"), "size", "window", "items")).alias("cs"))
        met = text_docs.join(of_doc, text_docs["doc_id"].eqNullSafe(of_doc["_id"]) & (text_docs["text_hash"] == of_doc["_hash"]))
        kept = met.select("doc_id", "text_hash", F.explode(let(item_words(F.col("text")), lambda ws: F.filter("cs", lambda c: same(ws, c)))).alias("c"))
        at = kept.select("doc_id", "text_hash", "c.start", "c.size", "c.items")
    return at.select("doc_id", "text_hash", "start", "size", F.explode_outer("items").alias("item_id"))


def covered(spans: Column) -> Column:
    """How many positions a sorted list of (start, size) covers."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["start"] + x["size"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["start"] + x["size"]).alias("to")),
        lambda acc: acc["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, item_ids (of items with occurring windows) and contaminated (at least a twentieth of its words is hit)."""
    per_doc = (
        hits(docs, benchmark, window, broadcast_windows)
        .groupBy("doc_id", "text_hash")
        .agg(covered(F.array_sort(F.collect_set(F.struct("start", "size")))).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
        .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    )
    own = docs.drop("n_words", "n_hit", "item_ids", "contaminated").withColumns({"_text_hash": F.xxhash64("text"), "n_words": F.size(item_words(F.col("text"))).cast("long")})
    joined = own.join(per_doc, own["doc_id"].eqNullSafe(per_doc["_id"]) & (own["_text_hash"] == per_doc["_hash"]), "left").drop("_id", "_hash", "_text_hash")
    none = F.array().cast("array<string>")
    filled = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", none)})
    return filled.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)
