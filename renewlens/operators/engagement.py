"""Listening activity in total, by plan and by subscription status.

The averages weight a user by the number of joined rows: engagement rows, user rows and
subscription rows of that user multiply. Each side is therefore counted down to one row per
user (and group) first, and the product of the counts serves as the weight. No user, however
many rows it has, produces more than one joined row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions import lifecycle
from renewlens.functions.exact import WEIGHT_TYPE, mean
from renewlens.functions.ordering import largest_first, smallest_first


def top_users(engagement: DataFrame, n: int = 10) -> DataFrame:
    """Users with most events; ties go to the smaller id."""
    return (
        engagement.select("user_id", "total_listens")
        .orderBy(largest_first("total_listens"), smallest_first("user_id"))
        .limit(n)
    )


def listening_range(engagement: DataFrame) -> DataFrame:
    average = mean(F.sum("total_listens"), F.count("total_listens"))
    return engagement.agg(
        F.min("total_listens").alias("min_listens"),
        F.max("total_listens").alias("max_listens"),
        average.cast("decimal(12,2)").alias("avg_listens"),
    )


def _per_user(engagement: DataFrame) -> DataFrame:
    if "engagement_rows" in engagement.columns:
        return engagement
    return engagement.groupBy("user_id").agg(
        F.count("*").alias("engagement_rows"),
        F.sum("total_listens").alias("listens"),
        F.max("total_listens").alias("most_listens"),
    )


def _copies(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def user_engagement(engagement: DataFrame, users: DataFrame) -> DataFrame:
    """One row per user with listening: sums, and the number of rows the user has in ``users``.

    Stored in buckets by user, it meets ``user_subscriptions`` without a shuffle.
    """
    known = _copies(users, "user_id", name="user_rows")
    return (
        _per_user(engagement)
        .join(known, "user_id", "left")
        .withColumn("user_rows", F.coalesce("user_rows", F.lit(0).cast("bigint")))
    )


def user_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions per user, plan and end, from which counts by plan or status of any day add up."""
    return _copies(
        subscriptions, "user_id", "subscription_type", "end_date", name="subscription_rows"
    )


def _summary(joined: DataFrame, group: str, weight: Column, *names: str) -> DataFrame:
    """Users, weighted mean and maximum per group; ``joined`` has one row per user and group."""
    users, average, most = names
    rows = F.sum(F.col("engagement_rows").cast(WEIGHT_TYPE) * weight)
    listens = F.sum(F.col("listens").cast("decimal(20,0)") * weight)
    return joined.groupBy(group).agg(
        F.count("*").alias(users),
        mean(listens, rows).alias(average),
        F.max("most_listens").alias(most),
    )


def subscription_counts(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Subscriptions per user, plan and status, from which counts by plan or by status add up."""
    status = lifecycle.status_label(F.col("end_date"), as_of).alias("subscription_status")
    return _copies(
        subscriptions.select("user_id", "subscription_type", status),
        "user_id",
        "subscription_type",
        "subscription_status",
        name="subscription_rows",
    )


def _added_up(counts: DataFrame, as_of: Column | None, *keys: str) -> DataFrame:
    if "end_date" in counts.columns and "subscription_status" in keys:
        counts = counts.withColumn(
            "subscription_status", lifecycle.status_label(F.col("end_date"), as_of)
        )
    return counts.groupBy(*keys).agg(F.sum("subscription_rows").alias("subscription_rows"))


def plan_engagement(
    engagement: DataFrame, users: DataFrame, subscriptions: DataFrame
) -> DataFrame:
    """Engagement of known users by the plan of their subscriptions, unsorted.

    ``subscriptions`` may be counted already, as ``subscription_counts`` or ``user_subscriptions``
    do, and ``engagement`` may be that of ``user_engagement``, where ``users`` is not read.
    """
    if "subscription_rows" in subscriptions.columns:
        plans = _added_up(subscriptions, None, "user_id", "subscription_type")
    else:
        plans = _copies(subscriptions, "user_id", "subscription_type", name="subscription_rows")
    if "user_rows" in engagement.columns:
        known = engagement.where(F.col("user_rows") > 0)
    else:
        known = _per_user(engagement).join(_copies(users, "user_id", name="user_rows"), "user_id")
    joined = known.join(plans, "user_id")
    weight = F.col("user_rows").cast(WEIGHT_TYPE) * F.col("subscription_rows").cast(WEIGHT_TYPE)
    return _summary(
        joined,
        "subscription_type",
        weight,
        "users_with_listens",
        "avg_listens_per_user",
        "max_listens",
    )


def status_engagement(
    engagement: DataFrame, subscriptions: DataFrame, *, as_of: Column
) -> DataFrame:
    """Engagement by status of the user's subscriptions, unsorted; a user may be in both.

    ``subscriptions`` may be counted already, as ``subscription_counts`` or ``user_subscriptions``
    do, and ``engagement`` summed by ``user_engagement``.
    """
    if "subscription_rows" in subscriptions.columns:
        statuses = _added_up(subscriptions, as_of, "user_id", "subscription_status")
    else:
        status = lifecycle.status_label(F.col("end_date"), as_of).alias("subscription_status")
        statuses = _copies(
            subscriptions.select("user_id", status),
            "user_id",
            "subscription_status",
            name="subscription_rows",
        )
    return _summary(
        _per_user(engagement).join(statuses, "user_id"),
        "subscription_status",
        F.col("subscription_rows").cast(WEIGHT_TYPE),
        "users",
        "avg_listens",
        "max_listens",
    )


def engagement_by_plan(
    engagement: DataFrame, users: DataFrame, subscriptions: DataFrame
) -> DataFrame:
    return plan_engagement(engagement, users, subscriptions).orderBy(
        largest_first("avg_listens_per_user"), smallest_first("subscription_type")
    )


def engagement_by_status(
    engagement: DataFrame, subscriptions: DataFrame, *, as_of: Column
) -> DataFrame:
    return status_engagement(engagement, subscriptions, as_of=as_of).orderBy(
        smallest_first("subscription_status")
    )
