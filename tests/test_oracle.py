"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from episodic.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

ORACLE = entry.oracle_sql()
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset_name", "traj_id", "t", "slot", "dim", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        assert len(rows) > 0
        return
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, sdf.columns)[0] == digest(orows, ocols)[0]
