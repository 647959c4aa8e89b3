"""Reporting tables built on the typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions import lifecycle
from renewlens.functions.exact import percent
from renewlens.functions.ordering import smallest_first


def bi_subscriptions(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Status flags, tenure and bucket per subscription. Tenure is computed once."""
    start, end, tenure = F.col("start_date"), F.col("end_date"), F.col("tenure_days")
    return subscriptions.select(
        "subscription_id",
        "user_id",
        "subscription_type",
        "start_date",
        "end_date",
        lifecycle.is_active(start, end, as_of).alias("is_active"),
        lifecycle.is_churned(end, as_of).alias("is_churned"),
        lifecycle.tenure_days(start, end, as_of).alias("tenure_days"),
    ).withColumn(
        "tenure_bucket",
        F.when(tenure.isNotNull(), lifecycle.bucket(tenure, lifecycle.MART_LAST_BUCKET)),
    )


def status_counts(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Subscriptions per plan, tenure bucket and status, with the smallest tenure of each cell.

    At most a few dozen rows per plan. Every count and rate of subscriptions adds up from them, so
    one scan serves all reports of a day.
    """
    return (
        bi_subscriptions(subscriptions, as_of=as_of)
        .groupBy("subscription_type", "tenure_bucket", "is_active", "is_churned")
        .agg(F.count("*").alias("subscriptions"), F.min("tenure_days").alias("first_tenure_day"))
    )


def is_counted(df: DataFrame) -> bool:
    """Whether a frame holds status counts and not single subscriptions."""
    return "subscriptions" in df.columns


def number(df: DataFrame) -> Column:
    """How many subscriptions there are, as an aggregate."""
    return F.coalesce(F.sum("subscriptions"), F.lit(0)) if is_counted(df) else F.count("*")


def number_if(df: DataFrame, flag: Column) -> Column:
    """How many subscriptions a flag holds for, as an aggregate."""
    if is_counted(df):
        return F.coalesce(F.sum(F.when(flag, F.col("subscriptions"))), F.lit(0))
    return F.count_if(flag)


def bi_payments(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Payments with the plan of their subscription.

    A plain inner join: Spark broadcasts the plans when they are small, and otherwise adaptive
    execution splits a partition that one hot subscription makes too large. A payment whose
    subscription id is repeated appears once per repeat.
    """
    plans = subscriptions.select("subscription_id", "subscription_type")
    return payments.join(plans, "subscription_id").select(
        "payment_id",
        "subscription_id",
        "user_id",
        "subscription_type",
        "amount_cents",
        "amount",
        "payment_method",
        F.col("payment_date").alias("payment_time_raw"),
        F.col("created_at").alias("created_time_raw"),
    )


def bi_engagement(engagement: DataFrame) -> DataFrame:
    return engagement.select("user_id", "total_listens")


def churn_by_bucket(marted: DataFrame) -> DataFrame:
    """Churn mart, unsorted, with the smallest tenure of each bucket as its sort key.

    From single subscriptions with their status, or from status counts.
    """
    total = number(marted)
    churned = number_if(marted, F.col("is_churned"))
    tenure = "first_tenure_day" if is_counted(marted) else "tenure_days"
    return (
        marted.where(F.col("tenure_bucket").isNotNull())
        .groupBy("tenure_bucket")
        .agg(
            total.alias("total_subscriptions"),
            churned.alias("churned_subscriptions"),
            percent(churned, total).alias("churn_rate_percent"),
            F.min(tenure).alias("first_tenure_day"),
        )
    )


def bi_churn_tenure(marted: DataFrame) -> DataFrame:
    """Total, churned and churn rate per tenure bucket, shortest tenure first."""
    return (
        churn_by_bucket(marted).orderBy(smallest_first("first_tenure_day")).drop("first_tenure_day")
    )
