"""Flagship and single-dataset pipeline: a row for every step, slot and dimension, not sums of them."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tools.check_oracle import digest

KINDS = ["view", "click", "purchase", "error", "signup"]


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Three users of five, four and one events."""
    rows = [(u, k) for u, n in ((1, 5), (2, 4), (3, 1)) for k in range(n)]
    at = dt.datetime(2024, 1, 1)
    path = tmp_path_factory.mktemp("events")
    pq.write_table(pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()),
        "ts": pa.array([at + dt.timedelta(hours=7 * i, seconds=3 * u) for i, (u, _) in enumerate(rows)], pa.timestamp("us")),
        "user_id": pa.array([u for u, _ in rows], pa.int64()),
        "event_type": pa.array([KINDS[(u + k) % 5] for u, k in rows]),
        "value": pa.array([1.5 * i + u for i, (u, _) in enumerate(rows)]),
        "props": pa.array([f'{{"k": {7 * i % 100}}}' for i in range(len(rows))]),
    }), path / "events.parquet")
    return str(path)


def check(spark, path, name):
    out = entry.queries()[name](spark, path)
    rows = [tuple(r) for r in out.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert out.columns == cols == ["dataset_name", "traj_id", "t", "slot", "dim", "value"]
    assert digest(rows, out.columns)[0] == digest(cur.fetchall(), cols)[0]
    return {r[1:5]: r[5] for r in rows}


def test_normalize_chunk_returns_every_chunk_value(spark, events):
    got = check(spark, events, "normalize_chunk")
    assert set(got) == {(u, t, s, d) for u, n in ((1, 5), (2, 4), (3, 1)) for t in range(n) for s in range(6) for d in range(7)}
    # a slot holds the value of that many steps on, and zero beyond the end
    assert all(v == (got[u, t + s, 0, d] if (u, t + s, 0, d) in got else 0.0) for (u, t, s, d), v in got.items())


def test_single_pipeline_returns_every_chunk_value_of_labelled_episodes(spark, events):
    got = check(spark, events, "single_pipeline")
    steps = {k[:2] for k in got}
    assert steps and {(u, t) for u, t in steps if u == 1} in (set(), {(1, t) for t in range(5)})
    assert set(got) == {(u, t, s, d) for u, t in steps for s in range(6) for d in range(7)}
    assert all(v == (got[u, t + s, 0, d] if (u, t + s, 0, d) in got else 0.0) for (u, t, s, d), v in got.items())
