"""Draws, halving and resuming of parameter searches."""

import math

import pytest

from cardlake.operators import search

SPACE = {"a": search.Uniform(-1.0, 1.0), "b": search.LogUniform(0.01, 0.3), "c": search.Whole(100, 3000, 50)}


def test_draws_depend_on_seed_and_number_only():
    many = [search.drawn(SPACE, 5, t) for t in range(400)]
    assert many[:3] == [search.drawn(SPACE, 5, t) for t in range(3)] and many[0] != search.drawn(SPACE, 6, 0)
    assert all(-1 <= p["a"] < 1 and 0.01 <= p["b"] <= 0.3 and 100 <= p["c"] <= 3000 and p["c"] % 50 == 0 for p in many)
    assert abs(sum(math.log(p["b"]) for p in many) / 400 - (math.log(0.01) + math.log(0.3)) / 2) < 0.15  # even in the logarithm
    assert {search.Whole(1, 3).of(u) for u in (0.0, 0.34, 0.99, 1.0)} == {1, 2, 3}


def quality(trials, fold):
    return {t: p["a"] + 0.01 * fold for t, p in trials.items()}


def test_halving_keeps_the_best(spark, tmp_path):
    table = search.new_table(spark, str(tmp_path / "t"))
    left = search.halving(table, SPACE, 12, 3, 5, quality)
    best = sorted(range(12), key=lambda t: -search.drawn(SPACE, 5, t)["a"])
    assert left == sorted(best[:3])
    by = {r["trial"]: r for r in search.ranks(table.read(), 3).collect()}
    assert [by[t]["rungs"] for t in best] == [3] * 3 + [2] * 3 + [1] * 6 and [by[t]["rank"] for t in best] == list(range(1, 13))


@pytest.mark.parametrize("one_by_one", [True, False])
def test_a_restarted_search_adds_no_trial_twice(spark, tmp_path, one_by_one):
    table, calls = search.new_table(spark, str(tmp_path / "t")), []

    def fails(trials, fold):
        calls.append((tuple(trials), fold))
        if fold == 1 and len(calls) > (7 if one_by_one else 1):
            raise RuntimeError("the driver is lost")
        return quality(trials, fold)

    with pytest.raises(RuntimeError):
        search.halving(table, SPACE, 6, 3, 5, fails, one_by_one)
    done = table.read().count()
    again = []
    left = search.halving(table, SPACE, 6, 3, 5, lambda t, f: again.append((tuple(t), f)) or quality(t, f), one_by_one)
    assert done >= 6 and not set(calls[:done if one_by_one else 1]) & set(again)
    assert table.read().count() == table.read().select("trial", "fold").distinct().count() == 6 + 3 + 2
    assert left == search.halving(search.new_table(spark, str(tmp_path / "u")), SPACE, 6, 3, 5, quality)


def test_failed_trials_are_last(spark, tmp_path):
    table = search.new_table(spark, str(tmp_path / "t"))
    left = search.halving(table, SPACE, 4, 2, 5, lambda ts, f: {t: float("nan") if t == 1 else float(t) for t in ts})
    assert left == [2, 3] and {r["trial"]: r["rank"] for r in search.ranks(table.read(), 2).collect()}[1] == 4
