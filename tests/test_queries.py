"""Every registered core query runs; those with SQL give the SQL's rows."""

import importlib

import pytest

from tests.compare import both, connect

MODULES = [importlib.import_module(f"quorix.plans.{m}") for m in ("skew_and_parsing", "relational", "local_and_io", "models")]
WITH_SQL = [(n, m) for m in MODULES for n in m.QUERIES if n in m.ORACLE]
ROWS_ONLY = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.ORACLE]


@pytest.mark.parametrize(("name", "module"), WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_same_as_sql(spark, data_dir, name, module):
    got, want = both(module.QUERIES[name](spark, data_dir), connect(data_dir), module.ORACLE[name])
    assert got == want


@pytest.mark.parametrize(("name", "module"), ROWS_ONLY, ids=[n for n, _ in ROWS_ONLY])
def test_gives_rows(spark, data_dir, name, module):
    assert module.QUERIES[name](spark, data_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
