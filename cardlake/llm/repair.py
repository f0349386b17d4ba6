"""Conversation structure repair by survivor-coalescence Viterbi: the cheapest edits that give roles `(s?(ua)+)?`.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then by a hash of the text). A row's first fault counts: blank (no sign besides `[\\x20\\x09-\\x0D]`),
duplicate (role and text seen earlier), truncated (its last such sign is not one of `.!?`). Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and is required for blank and duplicate
rows, Insert (an empty user or assistant row) 3; a truncated row that stays costs 3 more. Of equally cheap repairs that with the least edits in ASCII order is taken.

The four states of the grammar (nothing yet, after a leading system row, after user, after assistant) each keep their cheapest path as a leaf of a tree of edits. A node that only
one path goes on from is extended in place, a node that none needs any more is freed by its count of references, and once all paths share the root's only child its edits are settled and leave
the tree. A tie compares the paths below their last common node to their ends. A state is given up when another is cheaper by more than any continuation can make good.

At scale. Rows are brought together by conv_id once; duplicates are found there by a sort on role and hash, and a task then streams its rows in order, each conversation twice: first the rows
without texts, from which the edits follow, then the rows with texts, which get them. A conversation so needs a byte for an edit and one row in memory, however long it is. Its rows still pass
one task one after another, as the hash of a conversation's repaired text does by definition.

Defined cases: nulls are one space, for the damage too, but a null turn sorts first and has no part in gaps; rows with a null conv_id are one conversation. An empty role, like any that doesn't begin with
s, u or a, fits nowhere and is given another or deleted. Repeated rows are duplicates. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
#: States: nothing yet, after a leading system row, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to from each state.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only state that a user or assistant row leads to, and that role.
ONWARD = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
NEVER = 1 << 60
BATCH = 2000

EDITS = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("old_role", pa.string()), ("fault", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), *[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'string'}" for f in schema)


class Node:
    """A run of edits in the tree; refs counts the nodes and paths that go on from it."""

    __slots__ = ("edits", "parent", "refs")

    def __init__(self, parent: Node | None, edits: bytearray):
        self.parent, self.edits, self.refs = parent, edits, 0
        if parent is not None:
            parent.refs += 1


def _free(node: Node | None) -> None:
    while node is not None and node.refs == 0:
        node.parent, node = None, node.parent
        if node is not None:
            node.refs -= 1


def _less(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Whether the edits of path a (a node and what follows it) come first; both are compared from their last common node on."""

    def upward(node: Node) -> list[Node]:
        found = [node]
        while found[-1].parent is not None:
            found.append(found[-1].parent)
        return found[::-1]

    def head(nodes: list[Node], last: str, size: int) -> bytes:
        out = b""
        for edits in (*(n.edits for n in nodes), last.encode()):
            out += edits[: size - len(out)]
        return out

    x, y = upward(a[0]), upward(b[0])
    k, size = 0, 16
    while k < min(len(x), len(y)) and x[k] is y[k]:
        k += 1
    while (one := head(x[k:], a[1], size)) == (two := head(y[k:], b[1], size)) and len(one) == size:
        size *= 2
    return one < two


class Repair:
    """The edits of one conversation, row by row. settled grows as paths coalesce; pending is what waits in the tree."""

    def __init__(self):
        self.settled = bytearray()
        self.root = Node(None, bytearray())
        self.root.refs = 1
        self.paths: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self._inserts({START: (0, self.root, "")})

    def _inserts(self, best: dict[int, tuple[int, Node, str]]) -> None:
        """Takes best (by state: cost, node, edits that follow it), with rows inserted where that is cheaper, as the new paths."""
        todo = sorted(best, key=lambda s: best[s][0])
        while todo:
            state = todo.pop(0)
            cost, node, edits = best[state]
            if self._offer(best, ONWARD[state][0], (cost + INSERT, node, edits + "I")):
                todo.append(ONWARD[state][0])
        near = min(best[ASSISTANT][0] if ASSISTANT in best else NEVER, best[USER][0] + INSERT if USER in best else NEVER)
        if START in best and best[START][0] > near + DELETE:  # a leading system row can be deleted instead
            del best[START]
        if SYSTEM in best and best[SYSTEM][0] > near:
            del best[SYSTEM]
        old = [node for _, node in self.paths.values()]
        uses: dict[int, int] = {}
        for _, node, edits in best.values():
            uses[id(node)] = uses.get(id(node), 0) + 1
        made = {}
        for state, (cost, node, edits) in best.items():
            alone = uses[id(node)] == 1 and node.refs == sum(x is node for x in old)
            if alone:
                node.edits += edits.encode()
                made[state] = (cost, node)
            else:
                made[state] = (cost, Node(node, bytearray(edits.encode())) if edits else node)
        for _, node in made.values():
            node.refs += 1
        for node in old:
            node.refs -= 1
        for node in old:
            _free(node)
        self.paths = made
        for _, node in made.values():
            self._joined(node)
        self._coalesce()

    def _joined(self, node: Node) -> None:
        """Nodes above that nothing else goes on from become part of the node below."""
        while node is not self.root:
            above = node.parent
            while above is not self.root and above.refs == 1:
                above.edits += node.edits
                node.edits, node.parent, above = above.edits, above.parent, above.parent
            node = above

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node, str]], state: int, path: tuple[int, Node, str]) -> bool:
        if state in best and (best[state][0] < path[0] or best[state][0] == path[0] and not _less(path[1:], best[state][1:])):
            return False
        best[state] = path
        return True

    def _coalesce(self) -> None:
        """Edits that all paths share leave the tree."""
        leaves = [node for _, node in self.paths.values()]
        while True:
            root = self.root
            self.settled += root.edits
            root.edits = bytearray()
            below = {id(x): x for leaf in leaves for x in self._children(leaf, root)}
            if len(below) != 1 or any(leaf is root for leaf in leaves):
                return
            (self.root,) = below.values()
            self.root.parent = None

    @staticmethod
    def _children(leaf: Node, root: Node) -> Iterator[Node]:
        while leaf is not root:
            if leaf.parent is root:
                yield leaf
            leaf = leaf.parent

    def row(self, initial: str, fault: int) -> None:
        best: dict[int, tuple[int, Node, str]] = {}
        extra = TRUNCATED if fault == CUT_OFF else 0
        for state, (cost, node) in self.paths.items():
            self._offer(best, state, (cost + DELETE, node, "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            if (after := NEXT.get(initial, {}).get(state)) is not None:
                self._offer(best, after, (cost + extra, node, "K"))
            self._offer(best, ONWARD[state][0], (cost + REROLE + extra, node, "R"))
        self._inserts(best)

    @property
    def pending(self) -> int:
        seen = {}
        for _, leaf in self.paths.values():
            while leaf is not None:
                seen[id(leaf)], leaf = len(leaf.edits), leaf.parent
        return sum(seen.values())

    def end(self) -> bytes:
        """All edits of the cheapest path that ends in a state where a conversation may end."""
        ends = [self.paths[s] for s in (START, ASSISTANT) if s in self.paths]
        cost = min(c for c, _ in ends)
        node, *others = [n for c, n in ends if c == cost]
        for other in others:
            node = other if _less((other, ""), (node, "")) else node
        parts = []
        while node is not None:
            parts.append(node.edits)
            node = node.parent
        return bytes(self.settled + b"".join(parts[::-1]))


def ordered(rows: DataFrame) -> DataFrame:
    """Each row twice, in a conversation's order, each conversation in one partition: bulk 0 without its text, bulk 1 with it; and fault."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = plain.repartition("conv_id").withColumn("_mark", F.sha2("text", 256))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "_mark").orderBy(F.asc_nulls_first("turn"))) > 1
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(bare == "", BLANK).when(F.col("_again"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(0)
    both = marked.withColumn("_again", again).withColumn("fault", fault).withColumn("bulk", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("text", F.when(F.col("bulk") == 1, F.col("text")))
    return both.sortWithinPartitions("conv_id", "bulk", F.asc_nulls_first("turn"), "role", "_mark", "_again").select("conv_id", "bulk", "turn", "role", "fault", "text")


def repair(rows: DataFrame) -> DataFrame:
    """A row per edit, in the order of the repaired conversation, whose rows are those with a role: conv_id, edit (K, R, D or I), turn, old_role, fault (0 none, 1 blank, 2 duplicate, 3 truncated), role, text, cost.

    Inserted rows have no turn, old role or fault; deleted ones no role. Conversations stay whole in their partitions, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, edits, at, state, out = object(), None, b"", 0, START, []

        def edited() -> Iterator[tuple]:
            """The rows inserted before the next edit of a row, and at the end."""
            nonlocal at, state
            while at < len(edits) and edits[at : at + 1] == b"I":
                state, role = ONWARD[state]
                at += 1
                yield key, "I", None, None, None, role, "", INSERT

        for b in batches:
            for conv, bulk, turn, role, fault, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bulk == 0:
                    if conv != key or first is None:
                        out += edited()
                        key, first = conv, Repair()
                    first.row(role[:1], fault)
                    continue
                if first is not None:
                    edits, at, state, first = first.end(), 0, START, None
                out += edited()
                edit = chr(edits[at])
                at += 1
                extra = TRUNCATED if fault == CUT_OFF else 0
                if edit == "D":
                    out.append((conv, edit, turn, role, fault, None, text, DELETE))
                elif edit == "K":
                    state = NEXT[role[0]][state]
                    out.append((conv, edit, turn, role, fault, role, text, extra))
                else:
                    state, new = ONWARD[state]
                    out.append((conv, edit, turn, role, fault, new, text, REROLE + extra))
                if len(out) >= BATCH:
                    yield _batch(out, EDITS)
                    out = []
        out += edited()
        if out:
            yield _batch(out, EDITS)

    return ordered(rows).mapInArrow(run, _ddl(EDITS))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digest(edits: DataFrame) -> DataFrame:
    """What repair() returns, told by conversation: gaps, counts of faults and of illegal neighbours, cost, audit and a hash of the repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, out = None, False, []
        legal = {"su", "ua", "au"}

        def told() -> None:
            gaps = last - low + 1 - turns if turns else 0
            out.append((key, gaps, *faults[1:], illegal, cost, audit.decode(), sha.hexdigest()))

        for b in batches:
            for conv, edit, turn, old, fault, role, text, price in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen or conv != key:
                    if seen:
                        told()
                    key, seen = conv, True
                    low = last = initial = None
                    turns, faults, illegal, cost, audit, sha, kept = 0, [0, 0, 0, 0], 0, 0, bytearray(), hashlib.sha256(), False
                audit += edit.encode()
                cost += price
                if fault is not None:
                    faults[fault] += 1
                    illegal += initial is not None and initial + old[:1] not in legal
                    initial = old[:1]
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != last
                    last = turn
                if role is not None:
                    sha.update((f"\n{role}:" if kept else f"{role}:").encode() + text.encode())
                    kept = True
            if len(out) >= BATCH:
                yield _batch(out, DIGEST)
                out = []
        if seen:
            told()
        if out:
            yield _batch(out, DIGEST)

    return edits.mapInArrow(run, _ddl(DIGEST))


def damage(rows: DataFrame) -> DataFrame:
    """conversations with faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties it, 2 takes its `[.!?]` off, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hurt: Column = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(text("role"))
    marked = rows.select("conv_id", "turn", "role", "text").withColumn("_kind", kind).filter("_kind != 0")
    return marked.select("conv_id", "turn", role.alias("role"), hurt.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def with_all(told: DataFrame, rows: DataFrame) -> DataFrame:
    """told, with zeros for conversations of rows that it hasn't."""
    ids = rows.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    numbers = [F.coalesce(x, F.lit(0)).alias(x) for x in DIGEST.names[1:7]]
    sha = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return ids.join(told, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)
