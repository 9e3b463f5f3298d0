"""Every registered query with SQL must agree with DuckDB."""

import pytest

from signalgrid.queries import load_all
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_query_matches_sql(spark, con, name):
    q = QUERIES[name]
    problem, rows = compare(spark, con, name, q.build, q.sql, SF_DIR)
    assert problem == ""
    assert rows >= 0


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_learner_query_runs(spark, name):
    assert QUERIES[name].build(spark, SF_DIR).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "sample_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
