"""Registered queries against their SQL twins."""

import __spark_entry__ as entry_module
import pytest
from bindings.oracle import ORACLE
from bindings.queries import QUERIES

from tests.compare import compare, duckdb_session

SF_DIR = entry_module.SMOKE_DIR


@pytest.fixture(scope="module")
def duck():
    return duckdb_session(SF_DIR)


def test_every_statement_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    equal, message = compare(QUERIES[name](spark, SF_DIR), duck, ORACLE[name])
    assert equal, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
