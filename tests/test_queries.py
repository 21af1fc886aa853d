"""Every registered query on the driver's smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    if name in SQL:
        text, rows = compare(spark, con, SF_DIR, QUERIES[name], SQL[name])
        assert not text, text
    else:
        rows = len(QUERIES[name](spark, SF_DIR).collect())
    assert rows > 0, "no row can be wrong where there is none"


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["qid", "snippet_text"] and not got.isEmpty()
