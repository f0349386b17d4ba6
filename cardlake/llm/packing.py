"""Cost-balanced packing of token sequences.

A document is its ids by a public tokenizer (special tokens' strings are ordinary text), then id 0. Whole multiples of the capacity become full sequences of their own; what is left
of each document is packed, by windows of WINDOW_DOCS documents within a task: with T tokens left there are T // capacity full sequences. Pieces
go in descending order of estimated cost (LINEAR per token and QUADRATIC per token pair that attention compares) to the sequence of lowest cost that has room for them; a piece that
fits nowhere is cut to fill the emptiest one. The T % capacity tokens over wait for the task's next window; after its last one they fill sequences whose sizes are powers of
two. So sequences have no padding, and within a window costs are as even as the pieces allow. Tasks keep a window's ids only; nothing is shuffled.

A sequence's id is the task's partition number times 2 ** 40 plus a running number, which is the same when a task is repeated.

Defined cases: a null or empty text has the single id 0. Nulls elsewhere pass through. Repeated rows are packed as often as they occur. An
empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cardlake.llm.common import text_slices

CAPACITY, WINDOW_DOCS = 1024, 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A text with a run of so many blanks is left to the slower library: the faster one's pattern matcher runs out of stack on runs of a million.
BLANK_RUN = 50_000
_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    Where a vocabulary's ids follow the order of its merges, a faster library gives the same ids from them; else the vocabulary's own does.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str) -> Callable[[str], list[int]] | None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, signs = made["model"], byte_signs()
        pre = made["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made["normalizer"] and not made["post_processor"]
        if model["type"] != "BPE" or not plain or not model["vocab"].keys() >= signs.keys():
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(signs[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            slow = self.fast is None or (len(t) >= BLANK_RUN and _BLANKS.search(t))
            out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if slow else self.fast(t), "<u4").tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a path, made once by a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def balance(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) by sequence, for documents of less than capacity tokens each."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    if not sizes:
        return []
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    cost_of = lambda n: LINEAR * n + QUADRATIC * n * n

    def put(doc: int, start: int, n: int, s: int) -> None:
        out[s].append((doc, start, n))
        room[s] -= n
        cost[s] += cost_of(n)

    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            n = min(left, int(room[s]))
            put(doc, start, n, s)
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, window: int = WINDOW_DOCS) -> DataFrame:
    """One row per piece, with its ids, its place in its document and in its sequence."""
    path = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        short: list[tuple[int | None, int, int, bytes]] = []  # id, tokens of the document, tokens before, the ids left

        def held_back() -> list[tuple[int | None, int, int, bytes]]:
            """Takes from the waiting documents what would not fill a sequence."""
            rest, held = sum(len(x[3]) // 4 for x in short) % capacity, []
            while rest:
                doc_id, total, before, ids = short.pop()
                n = min(rest, len(ids) // 4)
                at = len(ids) - 4 * n
                held.append((doc_id, total, before + at // 4, ids[at:]))
                if at:
                    short.append((doc_id, total, before, ids[:at]))
                rest -= n
            return held

        def packed(last: bool) -> None:
            nonlocal sequence
            held = [] if last else held_back()
            for pieces in balance([len(x[3]) // 4 for x in short], capacity):
                offset = 0
                for d, start, n in pieces:
                    doc_id, total, before, ids = short[d]
                    rows.append((doc_id, before + start, n, ids[4 * start : 4 * (start + n)], total, sequence, offset))
                    offset += n
                sequence += 1
            short[:] = held

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            rows.clear()
            return out

        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], n, sequence, 0))
                    sequence += 1
                if n > whole:
                    short.append((doc_id, n, whole, ids[4 * whole :]))
                if len(short) >= window:
                    packed(last=False)
            if len(rows) > 2000:
                yield flushed()
        packed(last=True)
        if rows:
            yield flushed()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)
