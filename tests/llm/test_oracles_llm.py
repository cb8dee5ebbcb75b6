"""Queries with a SQL oracle match DuckDB; every query of the package is registered."""
import pytest

from tabwright.llm.queries import oracle_sql, queries
from tests.conftest import SF0001
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    r = compare(spark, duck(SF0001), name, queries()[name], oracle_sql()[name], SF0001)
    assert r["status"] == "ok", r


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names
