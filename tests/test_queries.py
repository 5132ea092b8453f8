"""Every query of the first part against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connection, duck_rows, spark_rows
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    names, rows = spark_rows(entry.queries()[name](spark, SF))
    assert rows
    if name in ORACLE:
        expected_names, expected = duck_rows(database, ORACLE[name])
        assert names == expected_names
        assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
