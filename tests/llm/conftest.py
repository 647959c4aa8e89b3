import duckdb
import pytest

from tests.conftest import MEDIUM, SMALL

TABLES = ("documents", "benchmark", "labels", "embeddings")


def _connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck_small():
    return _connect(SMALL)


@pytest.fixture(scope="session")
def duck_medium():
    return _connect(MEDIUM)


@pytest.fixture(scope="session")
def small_texts(duck_small):
    return dict(duck_small.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="session")
def medium_texts(duck_medium):
    return dict(duck_medium.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
