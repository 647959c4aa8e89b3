"""Every registered query of the reports against its SQL, run by DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
import oracle_queries

from .conftest import MEDIUM
from .helpers import same_rows

SQL = oracle_queries.oracle_sql()
EXTRA = set(entry.llm_queries.queries()) | {"pipeline"} if entry.llm_queries else set()
QUERIES = {name: query for name, query in entry.queries().items() if name not in EXTRA}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, MEDIUM)
    found = [tuple(row) for row in df.collect()]
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    same_rows(found, df.columns, cursor.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
