"""Conversation repair against a plain search over whole edit lists."""

import functools
import hashlib
import random

import pytest

from cardlake.llm import queries, repair

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, edits) by trying every edit of every row and up to three inserted rows between two."""

    @functools.cache
    def best(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        for x in "ua":
            if inserted < 3 and (last, x) in AFTER:
                c, e = best(i, x, inserted + 1)
                found.append((c + 3, "I" + e))
        if i < len(rows):
            initial, fault = rows[i]
            c, e = best(i + 1, last, 0)
            found.append((c + 4, "D" + e))
            if fault not in (1, 2):
                for x, letter, price in [(initial, "K", 0), ("u", "R", 3), ("a", "R", 3)]:
                    if (last, x) in AFTER:
                        c, e = best(i + 1, x, 0)
                        found.append((c + price + 3 * (fault == 3), letter + e))
        return min(found, default=(repair.NEVER, ""))

    return best(0, "", 0)


def test_edits_are_the_cheapest():
    dice = random.Random(3)
    for _ in range(4000):
        rows = [(dice.choice("suauax "), dice.choices(range(4), [6, 1, 1, 2])[0]) for _ in range(dice.randrange(1, 12))]
        found = repair.Repair()
        for r in rows:
            found.row(*r)
        assert found.end().decode() == cheapest(tuple(rows))[1], rows


def test_memory_of_long_conversations():
    found, most = repair.Repair(), 0
    for i in range(20_000):
        found.row("ua"[i % 2] if i % 7 else "s", 3 if i % 11 == 0 else 0)
        most = max(most, found.pending)
    assert most < 200
    never = repair.Repair()  # rows that fit nowhere: which are deleted stays open to the end, in few nodes
    for _ in range(5000):
        never.row("x", 0)
    assert len(never.end()) >= 5000 and len({id(n) for _, n in never.paths.values()}) <= 4


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 4, "user", "cut off"), (1, None, "system", "Be kind."),
        (2, 0, "assistant", " \n"), (2, None, None, None), (3, None, "user", "é?"), (3, None, "user", "é?"), (None, 0, "user", "No id."), (None, 1, None, "x."), (4, 0, "", ""), (5, 7, "tool", "word " * 30_000 + "."),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")


def test_odd_conversations(odd):
    got = {r["conv_id"]: r for r in repair.with_all(repair.digest(repair.repair(odd)), odd).collect()}
    assert got[1]["gaps"] == 2 and got[1]["duplicate"] == 1 and got[1]["truncated"] == 1
    texts = "system:Be kind.\nuser:Hi.\nassistant:Yes."
    assert (got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == ("KKKDD", 8, hashlib.sha256(texts.encode()).hexdigest())
    assert (got[2]["blank"], got[2]["audit"], got[2]["gaps"]) == (2, "DD", 0)
    assert (got[3]["duplicate"], got[3]["gaps"], got[3]["audit"]) == (1, 0, "KDI")
    assert got[None]["audit"] == "KR" and got[4]["audit"] == "D" and got[5]["audit"] == "D" and got[5]["cost"] == 4
    assert {r["conv_id"] for r in repair.with_all(repair.digest(repair.repair(repair.damage(odd))), odd).collect()} == {1, 2, 3, 4, 5, None}
    assert repair.with_all(repair.digest(repair.repair(odd.limit(0))), odd.limit(0)).isEmpty()


def test_repaired_rows(spark):
    edits = repair.repair(repair.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))).collect()
    by_conv = {}
    for r in edits:
        by_conv.setdefault(r["conv_id"], []).append(r)
    for rows in by_conv.values():
        roles = "".join(r["role"][0] for r in rows if r["role"])
        assert roles.removeprefix("s").replace("ua", "") == "" and roles != "s"
        turns = [r["turn"] for r in rows if r["edit"] != "I"]
        assert turns == sorted(turns)


def test_one_exchange(spark):
    plan = repair.repair(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query_registered():
    assert "op13_conversation_repair" in queries.QUERIES and "op13_conversation_repair" in queries.ORACLE
