import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from renewlens.plans.session import local_session

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
STAR_TABLES = ("customer", "orders", "lineitem", "events")
AS_OF = dt.date(2000, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = local_session(
        "renewlens-tests",
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.warehouse.dir": str(root / "warehouse"),
            "spark.checkpoint.dir": str(root / "shared"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_of():
    return AS_OF


@pytest.fixture
def today(spark):
    return F.lit(AS_OF)


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the medium tables."""
    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{MEDIUM}/{name}.parquet')")
    return con


@pytest.fixture
def setting(spark):
    """Change session settings for one test."""
    before = {}

    def change(**settings):
        for key, value in settings.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
