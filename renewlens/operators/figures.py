"""Headline figures, recomputation of published figures by a second route, report pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions import lifecycle
from renewlens.functions.exact import WEIGHT_TYPE, percent
from renewlens.functions.ordering import smallest_first
from renewlens.operators import engagement, marts, revenue


def headline(payments: DataFrame, subscriptions: DataFrame, *, as_of: Column) -> DataFrame:
    """Total subscriptions, overall churn rate and total revenue as one row.

    ``subscriptions`` may be status counts, ``payments`` may be revenue per subscription.
    """
    total = marts.number(subscriptions)
    if marts.is_counted(subscriptions):
        is_churned = F.col("is_churned")
    else:
        is_churned = lifecycle.is_churned(F.col("end_date"), as_of)
    churned = marts.number_if(subscriptions, is_churned)
    lives = subscriptions.agg(
        total.alias("total_subscriptions"), percent(churned, total).alias("churn_rate_percent")
    )
    money = revenue.total_revenue(payments)
    # Two one-row frames become one row: each column is null in one of them.
    return lives.unionByName(money, allowMissingColumns=True).agg(
        *[
            F.max(name).alias(name)
            for name in ("total_subscriptions", "churn_rate_percent", "total_revenue")
        ]
    )


def revenue_two_routes(
    payments: DataFrame, subscriptions: DataFrame, paid: DataFrame | None = None
) -> DataFrame:
    """Revenue by plan from every joined payment and from cents summed before the join.

    The second route starts from ``paid``, revenue per subscription, if that is given.
    """
    copies = revenue.subscription_copies(subscriptions)
    joined = (
        payments.select("subscription_id", "amount")
        .join(copies, "subscription_id")
        .groupBy("subscription_type")
        .agg(F.sum(F.col("amount") * F.col("copies").cast(WEIGHT_TYPE)).alias("joined_revenue"))
    )
    cents = revenue.subscription_revenue(payments if paid is None else paid)
    all_cents = F.sum(F.col("cents") * F.col("copies").cast(WEIGHT_TYPE))
    summed = (
        cents.join(copies, "subscription_id")
        .groupBy("subscription_type")
        .agg((all_cents / 100).cast("decimal(38,2)").alias("summed_revenue"))
    )
    return _side_by_side(
        joined, summed, "subscription_type", [("joined_revenue", "summed_revenue", "difference")]
    )


def churn_two_routes(
    marted: DataFrame, subscriptions: DataFrame, *, as_of: Column
) -> DataFrame:
    """Counts of the churn mart beside counts taken from subscriptions in one row.

    The mart's side may start from status counts; the direct one always reads the subscriptions.
    """
    mart = marts.churn_by_bucket(marted).select(
        "tenure_bucket",
        F.col("total_subscriptions").alias("mart_total"),
        F.col("churned_subscriptions").alias("mart_churned"),
    )
    return _side_by_side(
        mart,
        _direct_churn(subscriptions, as_of),
        "tenure_bucket",
        [
            ("mart_total", "direct_total", "total_difference"),
            ("mart_churned", "direct_churned", "churned_difference"),
        ],
    )


def _direct_churn(subscriptions: DataFrame, as_of: Column) -> DataFrame:
    """One conditional count per bucket over all rows, turned into rows afterwards."""
    start, end = F.col("start_date"), F.col("end_date")
    still_open = end.isNull() | (end >= as_of)
    days = F.when(still_open, F.datediff(as_of, start)).otherwise(F.datediff(end, start))
    lower, cells = None, []
    bounds = [*lifecycle.BOUNDED_BUCKETS, (None, lifecycle.MART_LAST_BUCKET)]
    for bound, label in bounds:
        limits = [days > lower] if lower is not None else []
        limits += [days <= bound] if bound is not None else []
        inside = reduce(lambda left, right: left & right, limits)
        cells.append(
            F.struct(
                F.lit(label).alias("tenure_bucket"),
                F.count_if(inside).alias("direct_total"),
                F.count_if(inside & ~still_open).alias("direct_churned"),
            )
        )
        lower = bound
    return (
        subscriptions.agg(F.array(*cells).alias("cells"))
        .select(F.inline("cells"))
        .where(F.col("direct_total") > 0)
    )


def _side_by_side(
    left: DataFrame, right: DataFrame, key: str, pairs: list[tuple[str, str, str]]
) -> DataFrame:
    """Null-safe full outer join on a key with the difference of each pair of columns."""
    both = left.alias("l").join(
        right.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full_outer"
    )
    columns = [F.coalesce(F.col(f"l.{key}"), F.col(f"r.{key}")).alias(key)]
    for first, second, difference in pairs:
        gap = F.coalesce(F.col(first), F.lit(0)) - F.coalesce(F.col(second), F.lit(0))
        columns += [F.col(first), F.col(second), gap.alias(difference)]
    return both.select(*columns).orderBy(smallest_first(key))


def _cell(figure: str, value: Column | None = None) -> Column:
    value = F.col(figure) if value is None else value
    return F.struct(F.lit(figure).alias("figure"), value.cast("double").alias("value"))


def _panel(df: DataFrame, panel: str, label: str | None, figures: list[str]) -> DataFrame:
    """Long form of a result: one row per label and figure."""
    cells = F.array(*[_cell(name) for name in figures])
    name = F.col(label) if label else F.lit("all")
    return df.select(name.alias("label"), cells.alias("cells")).select(
        F.lit(panel).alias("panel"), "label", F.inline("cells")
    )


def plan_page(
    payments: DataFrame,
    engagement_rows: DataFrame,
    users: DataFrame,
    subscriptions: DataFrame,
    *,
    as_of: Column,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Average revenue and engagement by plan, and engagement by status, in long form.

    One count of subscriptions per user serves both engagement panels, counted here unless it is
    given as ``subscriptions``; the revenue panel takes the copies per subscription, counted here
    from single subscriptions unless they are given.
    """
    if "subscription_rows" in subscriptions.columns:
        counts = subscriptions
    else:
        counts = engagement.subscription_counts(subscriptions, as_of=as_of)
    return reduce(
        DataFrame.unionByName,
        [
            _panel(
                revenue.plan_averages(payments, subscriptions if copies is None else copies),
                "average revenue by plan",
                "subscription_type",
                ["avg_revenue_per_subscription"],
            ),
            _panel(
                engagement.plan_engagement(engagement_rows, users, counts),
                "engagement by plan",
                "subscription_type",
                ["users_with_listens", "avg_listens_per_user", "max_listens"],
            ),
            _panel(
                engagement.status_engagement(engagement_rows, counts, as_of=as_of),
                "engagement by status",
                "subscription_status",
                ["users", "avg_listens", "max_listens"],
            ),
        ],
    )


def _churn_panels(marted: DataFrame) -> DataFrame:
    """Headline, plan and bucket churn from one pass over subscriptions, or their status counts.

    Rows are counted per plan and bucket first; the three levels are then added up from those
    few counts.
    """
    counts = marted.groupBy("subscription_type", "tenure_bucket").agg(
        marts.number(marted).alias("total"),
        marts.number_if(marted, F.col("is_churned")).alias("churned"),
    )
    levels = counts.groupingSets(
        [[], ["subscription_type"], ["tenure_bucket"]], "subscription_type", "tenure_bucket"
    ).agg(
        F.grouping("subscription_type").alias("all_plans"),
        F.grouping("tenure_bucket").alias("all_buckets"),
        F.sum("total").alias("total_subscriptions"),
        F.sum("churned").alias("churned_subscriptions"),
        percent(F.sum("churned"), F.sum("total")).alias("churn_rate_percent"),
    )
    by_plan, by_bucket = F.col("all_plans") == 0, F.col("all_buckets") == 0
    rate = F.col("churn_rate_percent")
    return (
        levels.where(~by_bucket | F.col("tenure_bucket").isNotNull())
        .select(
            F.when(by_plan, "churn rate by plan")
            .when(by_bucket, "churn by tenure")
            .otherwise("headline")
            .alias("panel"),
            F.when(by_plan, F.col("subscription_type"))
            .when(by_bucket, F.col("tenure_bucket"))
            .otherwise("all")
            .alias("label"),
            F.when(by_plan, F.array(_cell("churn_rate", rate)))
            .when(
                by_bucket,
                F.array(
                    _cell("total_subscriptions"),
                    _cell("churned_subscriptions"),
                    _cell("churn_rate_percent"),
                ),
            )
            .otherwise(F.array(_cell("total_subscriptions"), _cell("churn_rate_percent")))
            .alias("cells"),
        )
        .select("panel", "label", F.inline("cells"))
    )


def summary_page(
    payments: DataFrame,
    subscriptions: DataFrame,
    *,
    as_of: Column,
    copies: DataFrame | None = None,
    marted: DataFrame | None = None,
) -> DataFrame:
    """Churn severity, revenue share by plan and churn by tenure bucket, in long form.

    The total and the shares start from the same sum per subscription; where that is stored, the
    payments are not read. ``marted`` may be status counts.
    """
    if marted is None:
        marted = marts.bi_subscriptions(subscriptions, as_of=as_of)
    paid = revenue.subscription_revenue(payments)
    return reduce(
        DataFrame.unionByName,
        [
            _churn_panels(marted),
            _panel(revenue.total_revenue(paid), "headline", None, ["total_revenue"]),
            _panel(
                revenue.plan_shares(paid, subscriptions if copies is None else copies),
                "revenue by plan",
                "subscription_type",
                ["revenue", "revenue_share_percent"],
            ),
        ],
    )
