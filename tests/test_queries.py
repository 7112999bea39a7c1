"""Every registered query against its check SQL at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tools.check import normal  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name = file.split(".")[0]
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{file}')"
        )
    return connection


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == normal(cursor.fetchall(), columns)


def test_core_queries_have_their_sql():
    """Every query has check SQL, but for those that no SQL can say (see tests/llm)."""
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert all(name == "pipeline" or name.startswith("op") for name in without)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
