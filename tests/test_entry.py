"""Driver contract: entry() runs on sf0.001; every oracle key is a query."""
import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.count() > 0
    assert "target" in df.columns


def test_contract_keys():
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
