import pytest

from quorix.llm import queries as Q
from tests.compare import both, connect


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_same_as_sql(spark, data_dir, name):
    got, want = both(Q.QUERIES[name](spark, data_dir), connect(data_dir), Q.ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE])
def test_runs(spark, data_dir, name):
    assert Q.QUERIES[name](spark, data_dir).count() >= 0
