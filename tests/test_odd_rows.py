"""Queries on rows that the generated tables rarely hold, against their SQL."""

import math
import uuid
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cardlake.sources import records


def both(spark, folder, name, rows):
    """The query's rows and its SQL's, as dictionaries, of events in rows."""
    path = f"{folder}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    return [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()], [dict(zip(columns, r)) for r in rel.fetchall()]


def events(values, ks=None):
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(hours=i), i % 3, "click", v, '{"k": %d}' % (ks[i] if ks else 10 + i)) for i, v in enumerate(values)]


@pytest.mark.parametrize("values", [[1.5, 0.0, 2.5, 3.0], [1.5, -2.0, 2.5, None], [1.5, 2.5]])
def test_logarithms_of_no_amount(spark, tmp_path, values):
    got, want = both(spark, tmp_path, "log_normal_parameters", events(values))
    for c in ("mu", "sigma", "min", "q95"):
        assert got[0][c] == pytest.approx(want[0][c], nan_ok=True)
    assert values[1] or math.isinf(got[0]["mu"])


def test_logarithm_of_a_transform(spark, tmp_path):
    got, want = both(spark, tmp_path, "amount_transforms", events([0.0, -1.0, -3.5, 2.5, None]))
    told = lambda rows: {r["transaction_id"]: repr(r["amount_log"]) for r in rows}
    assert told(got) == told(want)


@pytest.mark.parametrize("name", ["entity_counts_of_the_day_and_so_far", "time_deltas_by_entity", "entity_counting_features"])
def test_entities_store_a_row_a_transaction(spark, tmp_path, monkeypatch, name):
    """Also with keys that are missing; what is stored between the steps has the table's rows, not one for each entity too."""
    monkeypatch.setattr(records, "scratch", lambda _, kind: f"file://{tmp_path}/{kind}-{uuid.uuid4().hex}")
    start, r = datetime(2024, 1, 30), np.random.default_rng(6)
    at = lambda: start + timedelta(minutes=int(r.integers(0, 5000)))
    rows = [(i, at(), int(r.integers(0, 4)) if i % 13 else None, "abc"[i % 3] if i % 11 else None, 1.0, '{"k": %d}' % r.integers(-7, 20) if i % 7 else "{}") for i in range(400)]
    got, want = both(spark, tmp_path, name, rows)
    key = lambda x: x["transaction_id"]
    assert sorted(got, key=key) == sorted(({c: x[c] for c in got[0]} for x in want), key=key)
    (held,) = [p for p in tmp_path.iterdir() if p.name.startswith("entities-")]
    assert spark.read.parquet(str(held)).count() == len(rows)
