"""Revenue in total, per plan and per subscription.

Payments are summed per subscription before they meet the plans, and repeated subscription
rows are counted into one. A subscription with any number of payments or copies is thus one
row on each side of the join, and its revenue is multiplied by the number of copies, which is
what joining every payment to every copy would add up to.

Both sides may be given collapsed already, as ``subscription_revenue`` and
``subscription_copies`` return them: stored once, they serve all reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions.exact import WEIGHT_TYPE, money_per, money_percent
from renewlens.functions.ordering import largest_first, smallest_first


def subscription_copies(subscriptions: DataFrame) -> DataFrame:
    """Distinct pairs of subscription and plan with the number of rows of each."""
    if "copies" in subscriptions.columns:
        return subscriptions
    return subscriptions.groupBy("subscription_id", "subscription_type").agg(
        F.count("*").alias("copies")
    )


def subscription_revenue(payments: DataFrame) -> DataFrame:
    """Revenue per subscription, in money and in cents; null where no payment has an amount."""
    if "subscription_revenue" in payments.columns:
        return payments
    return payments.groupBy("subscription_id").agg(
        F.sum("amount").alias("subscription_revenue"),
        F.sum(F.col("amount_cents").cast("decimal(12,0)")).alias("cents"),
    )


def plan_revenue(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Revenue and number of paying subscriptions per plan, unsorted."""
    paid = subscription_revenue(payments).join(
        subscription_copies(subscriptions), "subscription_id"
    )
    repeated = F.col("subscription_revenue") * F.col("copies").cast(WEIGHT_TYPE)
    # A pair of subscription and plan is unique here, so a plain count is the distinct count.
    return paid.groupBy("subscription_type").agg(
        F.sum(repeated).alias("revenue"), F.count("*").alias("subscriptions")
    )


def plan_averages(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Plan revenue with the average per paying subscription, unsorted."""
    average = money_per(F.col("revenue"), F.col("subscriptions"))
    return plan_revenue(payments, subscriptions).withColumn("avg_revenue_per_subscription", average)


def plan_shares(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Share of each plan in all revenue, unsorted.

    The total is a scalar subquery over the same sums, one value whatever the number of plans:
    plans are free text, and a window over all of them would be one task. Spark runs the shuffles
    that both share once.
    """
    by_plan = plan_revenue(payments, subscriptions)
    everything = by_plan.agg(F.sum("revenue")).scalar()
    return by_plan.withColumn("everything", everything).select(
        "subscription_type",
        "revenue",
        money_percent(F.col("revenue"), F.col("everything")).alias("revenue_share_percent"),
    )


def _richest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(largest_first("revenue"), smallest_first("subscription_type"))


def total_revenue(payments: DataFrame) -> DataFrame:
    """Sum of payments, or of revenue per subscription where that is given."""
    amount = "amount" if "amount" in payments.columns else "subscription_revenue"
    return payments.agg(F.sum(amount).alias("total_revenue"))


def revenue_by_plan(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return _richest_first(
        plan_revenue(payments, subscriptions).select("subscription_type", "revenue")
    )


def revenue_per_paying_subscription(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return _richest_first(plan_averages(payments, subscriptions))


def revenue_share_by_plan(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return _richest_first(plan_shares(payments, subscriptions))


def paying_subscriptions(payments: DataFrame) -> DataFrame:
    """Exact number of distinct paying subscriptions and total revenue in one pass."""
    return subscription_revenue(payments).agg(
        F.count("subscription_id").alias("unique_subscriptions"),
        F.sum("subscription_revenue").alias("total_revenue"),
    )


def top_subscriptions(payments: DataFrame, n: int = 10) -> DataFrame:
    """Subscriptions with the largest revenue; ties go to the smaller id."""
    return (
        subscription_revenue(payments)
        .select("subscription_id", "subscription_revenue")
        .orderBy(largest_first("subscription_revenue"), smallest_first("subscription_id"))
        .limit(n)
    )
