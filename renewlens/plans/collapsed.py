"""Tables that reports start from: collapsed to one row per key, and stored in buckets by it.

Two of them are joined by subscription, two by user. Both sides of a join have the same number of
buckets, so reports join them without moving a row, and one hot key is one row (or one per plan and
end) on each side. A folder keeps a list of its tables, ``layout``, as Parquet files alone do not
tell their buckets; ``open_folder`` declares them to the session's catalog as external tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from renewlens.operators import engagement, revenue
from renewlens.sources import storage, tables

Typed = Mapping[str, DataFrame]

# Name, key and how the table is made from the typed tables.
COLLAPSED: dict[str, tuple[str, Callable[[Typed], DataFrame]]] = {
    "subscription_revenue": (
        "subscription_id",
        lambda typed: revenue.subscription_revenue(typed["fct_payments"]),
    ),
    "subscription_copies": (
        "subscription_id",
        lambda typed: revenue.subscription_copies(typed["fct_subscriptions"]),
    ),
    "user_engagement": (
        "user_id",
        lambda typed: engagement.user_engagement(typed["engagement_per_user"], typed["dim_users"]),
    ),
    "user_subscriptions": (
        "user_id",
        lambda typed: engagement.user_subscriptions(typed["fct_subscriptions"]),
    ),
}
LAYOUT = "layout"


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_namespace(spark: SparkSession, namespace: str, typed: Typed) -> None:
    """Keep the collapsed tables as managed tables of a namespace."""
    for name, (key, make) in COLLAPSED.items():
        tables.save_bucketed(make(typed), f"{namespace}.{name}", _buckets(spark), key)


def folder_namespace(folder: str) -> str:
    """Where the tables of a folder are declared; a name of its own for every folder."""
    return f"renewlens_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"


def _declared(spark: SparkSession, folder: str) -> str:
    """The folder's namespace, whose own place is below the folder and holds no rows."""
    namespace = folder_namespace(folder)
    tables.create_namespace(spark, namespace, f"{folder}/_catalog")
    return namespace


def save_folder(spark: SparkSession, folder: str, typed: Typed, *, mode: str) -> None:
    """Keep the collapsed tables below a folder, and the list of them."""
    namespace, buckets, layout = _declared(spark, folder), _buckets(spark), []
    for name, (key, make) in COLLAPSED.items():
        df, path = make(typed), f"{folder}/{name}"
        # A name left by an earlier run is forgotten; its files are for ``mode`` to judge.
        tables.drop_table(spark, f"{namespace}.{name}")
        tables.save_bucketed(df, f"{namespace}.{name}", buckets, key, path=path, mode=mode)
        layout.append((name, key, buckets, tables.declared_columns(df)))
    rows = spark.createDataFrame(layout, "relation string, key string, buckets int, columns string")
    storage.export_parquet(rows.coalesce(1), f"{folder}/{LAYOUT}", mode=mode)


def open_folder(spark: SparkSession, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """Readers of the collapsed tables below a folder, which is looked at when one is first used.

    The session's catalog then holds a namespace with four names for the folder's files, until
    ``forget_folder``. Files stay in either case.
    """

    @cache
    def layout() -> dict:
        # One row per table.
        rows = spark.read.parquet(f"{folder}/{LAYOUT}").collect()
        namespace = _declared(spark, folder)
        for row in rows:
            tables.declare_bucketed(
                spark, f"{namespace}.{row.relation}", f"{folder}/{row.relation}",
                row.columns, row.buckets, row.key,
            )
        return {row.relation: f"{namespace}.{row.relation}" for row in rows}

    return {name: lambda name=name: spark.table(layout()[name]) for name in COLLAPSED}


def forget_folder(spark: SparkSession, folder: str) -> None:
    """Take a folder's tables out of the catalog. The files stay."""
    tables.drop_namespace(spark, folder_namespace(folder))
