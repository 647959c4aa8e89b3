"""The relations of one subscription service, built lazily from feeds or from stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.functions.lifecycle import as_of_day
from renewlens.functions.parsing import ID_TYPE
from renewlens.operators import marts, revenue, typed
from renewlens.plans import collapsed
from renewlens.plans.collapsed import COLLAPSED
from renewlens.sources import feeds, standins, storage, tables

AsOf = dt.date | str | None
Frame = DataFrame | Callable[[], DataFrame]

TYPED = ("dim_users", "fct_subscriptions", "fct_payments", "engagement_per_user")
# Subscriptions per plan, bucket and status as of a day: what all counts and rates start from.
STATUS = "subscription_status"
MARTS = ("bi_subscriptions", "bi_payments", "bi_engagement", "bi_churn_tenure")


def _day(as_of: AsOf | Column) -> dt.date | None:
    """The day, where it is known before a query runs."""
    if isinstance(as_of, str):
        return dt.date.fromisoformat(as_of)
    return as_of if isinstance(as_of, dt.date) else None


def _made(given: Frame) -> DataFrame:
    return given if isinstance(given, DataFrame) else given()


class Landing:
    """The four landed text feeds. A feed given as a function is read when it is first used."""

    def __init__(self, users: Frame, subscriptions: Frame, payments: Frame, listening: Frame):
        self._given = {
            "users": users,
            "subscriptions": subscriptions,
            "payments": payments,
            "listening": listening,
        }

    @cached_property
    def users(self) -> DataFrame:
        return _made(self._given["users"])

    @cached_property
    def subscriptions(self) -> DataFrame:
        return _made(self._given["subscriptions"])

    @cached_property
    def payments(self) -> DataFrame:
        return _made(self._given["payments"])

    @cached_property
    def listening(self) -> DataFrame:
        return _made(self._given["listening"])

    @classmethod
    def from_csv(
        cls,
        spark: SparkSession,
        *,
        users: str,
        subscriptions: str,
        payments: str,
        listening: str,
        **reading: bool,
    ) -> Landing:
        """Read four sets of CSV files; ``reading`` holds options of ``feeds.read_feed``."""
        paths = {
            "users": users,
            "subscriptions": subscriptions,
            "payments": payments,
            "listening": listening,
        }
        return cls(
            **{
                name: partial(feeds.read_feed, spark, paths[name], feed, **reading)
                for name, feed in feeds.all_feeds().items()
            }
        )

    @classmethod
    def from_standins(cls, spark: SparkSession, folder: str) -> Landing:
        return cls(
            lambda: standins.users_raw(spark, folder),
            lambda: standins.subscriptions_raw(spark, folder),
            lambda: standins.payments_raw(spark, folder),
            lambda: standins.listening_raw(spark, folder),
        )

    def spoiled(self) -> Landing:
        """Stand-in feeds with part of their rows made malformed."""
        return Landing(
            **{
                name: lambda name=name: standins.spoiled(name, getattr(self, name))
                for name in self._given
            }
        )

    def stripped(self) -> Landing:
        """The feeds without header lines that landed as data."""
        return Landing(
            **{
                name: lambda name=name, feed=feed: feeds.strip_header(getattr(self, name), feed)
                for name, feed in feeds.all_feeds().items()
            }
        )

    def rejects(self, id_type: str = ID_TYPE) -> dict[str, DataFrame]:
        """Malformed rows of each feed with their reasons."""
        return {
            name: feeds.rejects(getattr(self, name), feed)
            for name, feed in feeds.all_feeds(id_type).items()
        }


class Warehouse:
    """Typed tables, with the marts derived from them as of one day."""

    def __init__(
        self,
        dim_users: Frame,
        fct_subscriptions: Frame,
        fct_payments: Frame,
        engagement_per_user: Frame,
        as_of: AsOf | Column,
        *,
        status: Frame | None = None,
        **stored: Frame,
    ):
        """``stored`` names collapsed tables; ``status`` holds status counts with their day."""
        if not stored.keys() <= COLLAPSED.keys():
            raise TypeError(f"unknown tables: {sorted(stored.keys() - COLLAPSED.keys())}")
        self._collapsed, self._status, self._known_day = stored, status, _day(as_of)
        self._given = dict(
            zip(
                TYPED,
                (dim_users, fct_subscriptions, fct_payments, engagement_per_user),
                strict=True,
            )
        )
        self.as_of = as_of_day(as_of)

    @cached_property
    def dim_users(self) -> DataFrame:
        return _made(self._given["dim_users"])

    @cached_property
    def fct_subscriptions(self) -> DataFrame:
        return _made(self._given["fct_subscriptions"])

    @cached_property
    def fct_payments(self) -> DataFrame:
        return _made(self._given["fct_payments"])

    @cached_property
    def engagement_per_user(self) -> DataFrame:
        return _made(self._given["engagement_per_user"])

    @cached_property
    def subscription_revenue(self) -> DataFrame:
        """Stored if it was, else summed from the payments."""
        given = self._collapsed.get("subscription_revenue")
        return _made(given) if given else revenue.subscription_revenue(self.fct_payments)

    @cached_property
    def subscription_copies(self) -> DataFrame:
        """Stored if it was, else counted from the subscriptions."""
        given = self._collapsed.get("subscription_copies")
        return _made(given) if given else revenue.subscription_copies(self.fct_subscriptions)

    @cached_property
    def engagement(self) -> DataFrame:
        """Engagement summed per user if that was stored, else the rows as they are."""
        given = self._collapsed.get("user_engagement")
        return _made(given) if given else self.engagement_per_user

    @cached_property
    def user_subscriptions(self) -> DataFrame:
        """Subscriptions counted per user if that was stored, else the rows as they are."""
        given = self._collapsed.get("user_subscriptions")
        return _made(given) if given else self.fct_subscriptions

    @cached_property
    def _status_counts(self) -> DataFrame | None:
        """Stored status counts, if there are any of this day. The table has a few rows per plan."""
        if self._status is None or self._known_day is None:
            return None
        counts = _made(self._status).where(F.col("as_of") == F.lit(self._known_day)).drop("as_of")
        return None if counts.isEmpty() else counts

    @property
    def lives(self) -> DataFrame:
        """What is counted: stored status counts of the day, else single subscriptions."""
        return self.fct_subscriptions if self._status_counts is None else self._status_counts

    @property
    def marted(self) -> DataFrame:
        """The same with status and bucket of each subscription."""
        return self.bi_subscriptions if self._status_counts is None else self._status_counts

    @classmethod
    def from_landing(
        cls, landing: Landing, *, as_of: AsOf, id_type: str = ID_TYPE, strict: bool = False
    ) -> Warehouse:
        """Type the feeds on every read. ``strict`` fails on a malformed row."""
        how = {"id_type": id_type, "strict": strict}
        return cls(
            lambda: typed.dim_users(landing.users, **how),
            lambda: typed.fct_subscriptions(landing.subscriptions, **how),
            lambda: typed.fct_payments(landing.payments, **how),
            lambda: typed.engagement_per_user(landing.listening, **how),
            as_of,
        )

    @classmethod
    def from_tables(cls, spark: SparkSession, namespace: str, *, as_of: AsOf) -> Warehouse:
        stored = {name: partial(spark.table, f"{namespace}.{name}") for name in COLLAPSED}
        given = (partial(spark.table, f"{namespace}.{name}") for name in TYPED)
        return cls(*given, as_of, status=partial(spark.table, f"{namespace}.{STATUS}"), **stored)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, *, as_of: AsOf) -> Warehouse:
        """Read what ``save_parquet`` stored; see ``collapsed.open_folder`` for the catalog."""
        given = (partial(spark.read.parquet, f"{folder}/{name}") for name in TYPED)
        status = partial(spark.read.parquet, f"{folder}/{STATUS}")
        return cls(*given, as_of, status=status, **collapsed.open_folder(spark, folder))

    def typed_tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TYPED}

    def save_tables(self, spark: SparkSession, namespace: str) -> None:
        """Parse the feeds once and keep the typed tables in the catalog.

        What reports start from is then made from the stored tables: sums per subscription and
        per user, in buckets, and the status counts of this warehouse's day.
        """
        tables.create_namespace(spark, namespace)
        for name, df in self.typed_tables().items():
            tables.save_table(df, f"{namespace}.{name}")
        stored = {name: spark.table(f"{namespace}.{name}") for name in TYPED}
        collapsed.save_namespace(spark, namespace, stored)
        tables.save_table(self.dated_status(stored["fct_subscriptions"]), f"{namespace}.{STATUS}")

    def save_parquet(self, folder: str, *, mode: str = "errorifexists") -> None:
        for name, df in self.typed_tables().items():
            storage.export_parquet(df, f"{folder}/{name}", mode=mode)
        spark = self.fct_payments.sparkSession
        stored = {name: spark.read.parquet(f"{folder}/{name}") for name in TYPED}
        collapsed.save_folder(spark, folder, stored, mode=mode)
        self.save_status(folder, stored["fct_subscriptions"], mode=mode)

    def dated_status(self, subscriptions: DataFrame) -> DataFrame:
        """Status counts with their day. Each writing replaces those of all days before."""
        counts = marts.status_counts(subscriptions, as_of=self.as_of)
        return counts.withColumn("as_of", self.as_of)

    def save_status(
        self, folder: str, subscriptions: DataFrame, *, mode: str = "errorifexists"
    ) -> None:
        storage.export_parquet(self.dated_status(subscriptions), f"{folder}/{STATUS}", mode=mode)

    @property
    def bi_subscriptions(self) -> DataFrame:
        return marts.bi_subscriptions(self.fct_subscriptions, as_of=self.as_of)

    @property
    def bi_payments(self) -> DataFrame:
        return marts.bi_payments(self.fct_payments, self.fct_subscriptions)

    @property
    def bi_engagement(self) -> DataFrame:
        return marts.bi_engagement(self.engagement_per_user)

    @property
    def bi_churn_tenure(self) -> DataFrame:
        return marts.bi_churn_tenure(self.marted)

    def relations(self) -> dict[str, DataFrame]:
        """All eight relations by name, for example to publish them as views."""
        return {**self.typed_tables(), **{name: getattr(self, name) for name in MARTS}}

