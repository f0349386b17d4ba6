"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Only DataFrame expressions touch rows. Each rule gives 1 (good), -1 (bad) or 0 (abstains). The corpus is reduced to counts of vote
patterns (at most 3 ** len(RULES) rows whatever the corpus size); expectation-maximisation over those counts estimates, for each rule, how
often it votes "good" on good and on bad documents, and the share of good documents. A document is kept if its posterior probability of
being good reaches a threshold and it passes the base checks.

Defined cases: a null, empty or blank text has no words, fails the base check and is not kept. Rows are never joined, so repeated rows and
repeated or null ids keep one result row each. An empty table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import cut, let, words

WINDOW = 8
#: The rules, in the order of their votes.
RULES = ("symbols", "capitals", "shouts", "letters", "repeats", "lines", "variety", "length")
#: Where EM starts, and what it is held to by ANCHOR times the corpus in pseudo-counts: chances of a bad vote, an abstention and a good vote
#: on a good and on a bad document. Kinds of junk rarely coincide, so a rule catches a part of the bad documents and few of the good.
START = {"good": (0.005, 0.495, 0.5), "bad": (0.25, 0.55, 0.2)}
ANCHOR = 0.2


def repeated_words(ws: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more in the list; O(n log n) in its length."""

    def in_doubles(marks: Column) -> Column:
        at = F.transform(
            F.filter(
                marks,
                lambda x, i: (x["h"] == F.try_element_at(marks, i + 2)["h"]) | ((i > 0) & (x["h"] == F.try_element_at(marks, F.greatest(i, F.lit(1)))["h"])),
            ),
            lambda x: x["i"],
        )
        return let(
            F.array_sort(at),
            lambda s: F.aggregate(
                s,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
                lambda acc: acc["n"],
            ),
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), in_doubles)
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def features(docs: DataFrame) -> DataFrame:
    """docs with the base measures and those the rules need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col("text")),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeated_words(ws).alias("n_repeat_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct_words"),
        ),
    )
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    n = lambda kept: (F.length(text) - F.length(F.regexp_replace(text, kept, ""))).cast("long")
    wide = docs.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": n(r"[#*$%&|<>]+"), "n_capitals": n(r"[\p{Lu}]+"), "n_shouts": n("!+")})
    wide = wide.withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct_words")} | {c: F.col(f"_l.{c}") for c in ("n_lines", "n_dup_lines")})
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return wide.drop("_w", "_l").withColumn("base_failed", base)


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Most rules know one kind of junk and abstain where they don't see it."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    bad = lambda c: F.when(c, -1).otherwise(0)
    both = lambda c, good: F.when(c, -1).when(good, 1).otherwise(0)
    variety = F.col("n_distinct_words") / F.sqrt(n)  # distinct words over the root of all, which long texts change little
    odd = (F.col("n_symbols") + F.col("n_shouts")) / n
    return {
        "symbols": bad(F.col("n_symbols") > 0.25 * n),
        "capitals": bad(F.col("n_capitals") > 0.4 * chars),
        "shouts": bad(F.col("n_shouts") > 0.25 * n),
        "letters": both(odd > 0.3, (odd < 0.05) & (F.col("n_capitals") < 0.2 * chars)),
        "repeats": bad(F.col("n_repeat_words") > 0.3 * n),
        "lines": bad((F.col("n_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.col("n_lines"))),
        "variety": both((n >= 40) & (variety < 2), (n >= 40) & (variety > 4)),
        "length": both(n < 20, n >= 40),
    }


@dataclass(frozen=True)
class Model:
    """prior: share of good documents; good, bad: by rule, the chances of a bad vote, an abstention and a good vote on such documents."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> Model:
    """Expectation-maximisation over counted vote patterns; the pseudo-counts keep it defined where a rule never votes."""
    patterns = sorted(patterns)
    model = Model(0.9, (START["good"],) * len(RULES), (START["bad"],) * len(RULES))
    held = ANCHOR * sum(n for _, n in patterns) + 1
    for _ in range(rounds):
        ps = [posterior(model, vs) for vs, _ in patterns]
        masses = {"good": [n * p for p, (_, n) in zip(ps, patterns, strict=True)], "bad": [n * (1 - p) for p, (_, n) in zip(ps, patterns, strict=True)]}
        total = {y: math.fsum(m) for y, m in masses.items()}
        share = {"good": 0.9, "bad": 0.1}
        rates = {
            y: tuple(
                tuple(
                    (math.fsum(w for w, (vs, _) in zip(m, patterns, strict=True) if vs[r] == v) + held * share[y] * START[y][v + 1]) / (total[y] + held * share[y])
                    for v in (-1, 0, 1)
                )
                for r in range(len(RULES))
            )
            for y, m in masses.items()
        }
        model = Model((total["good"] + 0.9 * held) / (total["good"] + total["bad"] + held), rates["good"], rates["bad"])
    return model


def log_odds(model: Model) -> tuple[float, list[tuple[float, ...]]]:
    """The prior's log odds and, by rule, what a bad vote, an abstention and a good vote add."""
    return math.log(model.prior / (1 - model.prior)), [tuple(math.log(g / b) for g, b in zip(gs, bs, strict=True)) for gs, bs in zip(model.good, model.bad, strict=True)]


def posterior(model: Model, vs: tuple[int, ...]) -> float:
    start, adds = log_odds(model)
    x = start + sum(add[v + 1] for v, add in zip(vs, adds, strict=True))
    return 1 / (1 + math.exp(-max(min(x, 700), -700)))


def fit(measured: DataFrame, rounds: int = 60) -> Model:
    """The label model of a measured corpus; what reaches the driver is at most 3 ** len(RULES) counts."""
    counts = measured.select(*[v.alias(f"v_{r}") for r, v in votes().items()]).groupBy(*[f"v_{r}" for r in RULES]).count().collect()
    return em([(tuple(x[:-1]), x[-1]) for x in counts], rounds)


def judge(measured: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds quality, the posterior probability, and kept."""
    start, adds = log_odds(model)
    x = F.lit(start)
    for v, (down, none, up) in zip(votes().values(), adds, strict=True):
        x = x + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(down)).otherwise(F.lit(none))
    return measured.withColumn("quality", 1 / (1 + F.exp(-x))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept, with their own columns. Texts are measured once: the measures are stored beside them for both passes."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    measured = cut(features(own).drop("text"), "quality")
    kept = judge(measured, fit(measured), threshold).filter("kept")
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
