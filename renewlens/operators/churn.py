"""Counts and rates of active and churned subscriptions.

Each metric is one scan with a partial aggregate per task, so only a few rows per task are
shuffled however large a plan is. Ties in a descending order are broken by the plan.

``subscriptions`` may also be the status counts of ``marts.status_counts`` for the same day: stored
once, they serve all reports without another look at the subscriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions import lifecycle
from renewlens.functions.exact import percent
from renewlens.functions.ordering import largest_first, smallest_first
from renewlens.operators.marts import is_counted, number, number_if


def _active(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    if is_counted(subscriptions):
        return subscriptions.where("is_active")
    return subscriptions.where(lifecycle.is_active(F.col("start_date"), F.col("end_date"), as_of))


def _is_churned(subscriptions: DataFrame, as_of: Column) -> Column:
    if is_counted(subscriptions):
        return F.col("is_churned")
    return lifecycle.is_churned(F.col("end_date"), as_of)


def _is_running(subscriptions: DataFrame, as_of: Column) -> Column:
    if is_counted(subscriptions):
        return ~F.col("is_churned")
    return lifecycle.is_running(F.col("end_date"), as_of)


def _churned(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    return subscriptions.where(_is_churned(subscriptions, as_of))


def _count_by_plan(subscriptions: DataFrame, name: str) -> DataFrame:
    return (
        subscriptions.groupBy("subscription_type")
        .agg(number(subscriptions).alias(name))
        .orderBy(largest_first(name), smallest_first("subscription_type"))
    )


def active_subscriptions(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return _active(subscriptions, as_of).agg(number(subscriptions).alias("active_subscriptions"))


def active_by_plan(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return _count_by_plan(_active(subscriptions, as_of), "active_subscriptions")


def total_by_plan(subscriptions: DataFrame) -> DataFrame:
    return _count_by_plan(subscriptions, "total_subscriptions")


def churned_by_plan(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return _count_by_plan(_churned(subscriptions, as_of), "churned_subscriptions")


def churned_counts(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Churned count of each plan without naming the plan; see churned_by_plan for the names."""
    return churned_by_plan(subscriptions, as_of=as_of).select("churned_subscriptions")


def plan_churn_rates(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Churn rate per plan, unsorted."""
    churned = number_if(subscriptions, _is_churned(subscriptions, as_of))
    return subscriptions.groupBy("subscription_type").agg(
        percent(churned, number(subscriptions)).alias("churn_rate")
    )


def churn_rate_by_plan(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return plan_churn_rates(subscriptions, as_of=as_of).orderBy(
        largest_first("churn_rate"), smallest_first("subscription_type")
    )


def status_rates_by_plan(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Share of running and of churned subscriptions per plan; the two cover all rows."""
    total = number(subscriptions)
    running = number_if(subscriptions, _is_running(subscriptions, as_of))
    churned = number_if(subscriptions, _is_churned(subscriptions, as_of))
    return (
        subscriptions.groupBy("subscription_type")
        .agg(
            percent(running, total).alias("active_rate_percent"),
            percent(churned, total).alias("churn_rate_percent"),
        )
        .orderBy(smallest_first("subscription_type"))
    )


def _churned_lifetimes(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """Churned subscriptions with days from start to end; an unknown start is in the last bucket.

    Of status counts, a cell with its smallest number of days: a churned subscription's tenure ends
    with it, so the cells' buckets are these buckets but for the name of the last.
    """
    if is_counted(subscriptions):
        last = F.col("tenure_bucket").isNull() | (
            F.col("tenure_bucket") == lifecycle.MART_LAST_BUCKET
        )
        return _churned(subscriptions, as_of).select(
            "subscription_type",
            F.col("first_tenure_day").alias("lifetime_days"),
            F.when(last, lifecycle.METRIC_LAST_BUCKET)
            .otherwise(F.col("tenure_bucket"))
            .alias("tenure_bucket"),
            "subscriptions",
        )
    days = F.datediff("end_date", "start_date")
    return _churned(subscriptions, as_of).select(
        "subscription_type",
        days.alias("lifetime_days"),
        lifecycle.bucket(days, lifecycle.METRIC_LAST_BUCKET).alias("tenure_bucket"),
    )


def churned_by_bucket(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return (
        _churned_lifetimes(subscriptions, as_of)
        .groupBy("tenure_bucket")
        .agg(
            number(subscriptions).alias("churned_subscriptions"),
            F.min("lifetime_days").alias("first_day"),
        )
        .orderBy(smallest_first("first_day"))
        .drop("first_day")
    )


def churned_by_plan_and_bucket(subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    return (
        _churned_lifetimes(subscriptions, as_of)
        .groupBy("subscription_type", "tenure_bucket")
        .agg(
            number(subscriptions).alias("churned_subscriptions"),
            F.min("lifetime_days").alias("first_day"),
        )
        .orderBy(smallest_first("subscription_type"), smallest_first("first_day"))
        .drop("first_day")
    )
