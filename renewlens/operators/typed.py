"""Typed tables from the landed text feeds. Malformed rows are left out (see sources.feeds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions.parsing import ID_TYPE, cents_to_money
from renewlens.sources import feeds


def dim_users(
    users_raw: DataFrame,
    *,
    id_type: str = ID_TYPE,
    strict: bool = False,
    judged: bool = False,
) -> DataFrame:
    """One row per landed user row. The password hash stays behind."""
    feed = feeds.users_feed(id_type)
    return feeds.typed_rows(
        users_raw,
        feed,
        "row_id",
        feed.typed("user_id"),
        "username",
        "email",
        "first_name",
        "last_name",
        "subscription_type",
        "created_at",
        strict=strict,
        judged=judged,
    )


def fct_subscriptions(
    subscriptions_raw: DataFrame,
    *,
    id_type: str = ID_TYPE,
    strict: bool = False,
    judged: bool = False,
) -> DataFrame:
    feed = feeds.subscriptions_feed(id_type)
    return feeds.typed_rows(
        subscriptions_raw,
        feed,
        "row_id",
        feed.typed("subscription_id"),
        feed.typed("user_id"),
        "subscription_type",
        feed.typed("start_date"),
        feed.typed("end_date"),
        "created_at",
        strict=strict,
        judged=judged,
    )


def fct_payments(
    payments_raw: DataFrame,
    *,
    id_type: str = ID_TYPE,
    strict: bool = False,
    judged: bool = False,
) -> DataFrame:
    """Amounts land as whole cents; the money column is exact."""
    feed = feeds.payments_feed(id_type)
    cents = feed.rules["amount"].typed(F.col("amount"))
    return feeds.typed_rows(
        payments_raw,
        feed,
        "row_id",
        feed.typed("payment_id"),
        feed.typed("user_id"),
        feed.typed("subscription_id"),
        cents.alias("amount_cents"),
        cents_to_money(cents).alias("amount"),
        feed.typed("payment_date"),
        "payment_method",
        "created_at",
        strict=strict,
        judged=judged,
    )


def listening_users(
    listening_raw: DataFrame,
    *,
    id_type: str = ID_TYPE,
    strict: bool = False,
    judged: bool = False,
) -> DataFrame:
    """The user of each event, still as text."""
    feed = feeds.listening_feed(id_type)
    return feeds.typed_rows(listening_raw, feed, "user_id", strict=strict, judged=judged)


def listens_per_user(users: DataFrame, *, id_type: str = ID_TYPE) -> DataFrame:
    """Events per user. Groups by the text of the id: '7' and '07' are two rows with id 7."""
    per_text = users.groupBy("user_id").agg(F.count("*").alias("total_listens"))
    return per_text.select(feeds.listening_feed(id_type).typed("user_id"), "total_listens")


def engagement_per_user(
    listening_raw: DataFrame, *, id_type: str = ID_TYPE, strict: bool = False
) -> DataFrame:
    users = listening_users(listening_raw, id_type=id_type, strict=strict)
    return listens_per_user(users, id_type=id_type)
