"""Every query with a SQL oracle matches DuckDB on the same parquet tables (sf0.001)."""
import pytest

from tabwright.plans.queries import oracle_sql, queries
from tests.conftest import SF0001
from tests.oracle import compare, duck

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, queries()[name], ORACLES[name], SF0001)
    assert r["status"] == "ok", r


def test_every_query_has_a_callable():
    qs = queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 90
