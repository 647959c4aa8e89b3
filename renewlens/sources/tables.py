"""Namespaces, tables and views in the session catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def create_namespace(spark: SparkSession, name: str, folder: str | None = None) -> None:
    """Create a namespace if it is missing, with its tables below a folder if one is named."""
    place = f" LOCATION '{folder}'" if folder else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}{place}")


def use_namespace(spark: SparkSession, name: str) -> None:
    """Make a namespace the default. Spark keeps one default, not a search list."""
    spark.catalog.setCurrentDatabase(name)


def namespace_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types in order."""
    return df.dtypes


def check_columns(df: DataFrame, expected: Mapping[str, str]) -> None:
    """Fail when names, order or types differ from the contract."""
    found, wanted = df.dtypes, list(expected.items())
    if found != wanted:
        raise ValueError(f"columns differ: found {found}, expected {wanted}")


def save_table(df: DataFrame, name: str) -> None:
    """Store a frame as a Parquet table, replacing what was there.

    No bucketing of rows: one key may hold a large part of them, and a bucketed read would hand
    all of them to one task. Operators collapse keys before they shuffle instead.
    """
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def save_bucketed(
    df: DataFrame,
    name: str,
    buckets: int,
    key: str,
    *,
    path: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Store a frame with few rows per key in buckets, which joins on the key need not shuffle.

    With a ``path`` the table is external: dropping it leaves the files.
    """
    writer = (
        df.repartition(buckets, key)
        .write.mode(mode)
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
    )
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def declared_columns(df: DataFrame) -> str:
    """The columns of a frame as a table declaration names them."""
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def declare_bucketed(
    spark: SparkSession, name: str, path: str, columns: str, buckets: int, key: str
) -> None:
    """Make files that ``save_bucketed`` wrote to a path known to the catalog under a name."""
    drop_table(spark, name)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {_quoted(name)} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def empty_table(spark: SparkSession, name: str) -> None:
    """Remove all rows and keep the table."""
    spark.sql(f"TRUNCATE TABLE {_quoted(name)}")


def drop_namespace(spark: SparkSession, name: str) -> None:
    """Drop a namespace with all its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(name)} CASCADE")


def publish_views(relations: Mapping[str, DataFrame], *, prefix: str = "") -> None:
    """Create or replace one temporary view per relation. A prefix keeps a caller's own views."""
    for name, df in relations.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def drop_views(spark: SparkSession, names: Iterable[str], *, prefix: str = "") -> None:
    for name in names:
        spark.catalog.dropTempView(f"{prefix}{name}")
