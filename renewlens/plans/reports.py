"""Named reports: every relation, metric and figure as a function of the warehouse."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame

from renewlens.operators import checks, churn, engagement, figures, revenue
from renewlens.plans.warehouse import Landing, Warehouse
from renewlens.sources.standins import OFFSET

Report = Callable[[Warehouse], DataFrame]
Check = Callable[[Landing, Warehouse], DataFrame]

RELATIONS: dict[str, Report] = {
    "v1_dim_users": lambda w: w.dim_users,
    "v2_fct_subscriptions": lambda w: w.fct_subscriptions,
    "v3_fct_payments": lambda w: w.fct_payments,
    "v4_engagement_per_user": lambda w: w.engagement_per_user,
    "v5_bi_subscriptions": lambda w: w.bi_subscriptions,
    "v6_bi_payments": lambda w: w.bi_payments,
    "v7_bi_engagement": lambda w: w.bi_engagement,
    "v8_bi_churn_tenure": lambda w: w.bi_churn_tenure,
}

METRICS: dict[str, Report] = {
    "m01_active_subscriptions": lambda w: churn.active_subscriptions(
        w.lives, as_of=w.as_of
    ),
    "m02_active_by_plan": lambda w: churn.active_by_plan(w.lives, as_of=w.as_of),
    "m03_total_by_plan": lambda w: churn.total_by_plan(w.lives),
    "m04_churned_counts": lambda w: churn.churned_counts(w.lives, as_of=w.as_of),
    "m04l_churned_by_plan": lambda w: churn.churned_by_plan(w.lives, as_of=w.as_of),
    "m05_churn_rate_by_plan": lambda w: churn.churn_rate_by_plan(
        w.lives, as_of=w.as_of
    ),
    "m06_status_rates_by_plan": lambda w: churn.status_rates_by_plan(
        w.lives, as_of=w.as_of
    ),
    "m07_churned_by_bucket": lambda w: churn.churned_by_bucket(
        w.lives, as_of=w.as_of
    ),
    "m08_churned_by_plan_and_bucket": lambda w: churn.churned_by_plan_and_bucket(
        w.lives, as_of=w.as_of
    ),
    "m09_total_revenue": lambda w: revenue.total_revenue(w.fct_payments),
    "m10_revenue_by_plan": lambda w: revenue.revenue_by_plan(
        w.subscription_revenue, w.subscription_copies
    ),
    "m11_revenue_per_paying_subscription": lambda w: revenue.revenue_per_paying_subscription(
        w.subscription_revenue, w.subscription_copies
    ),
    "m12_revenue_share_by_plan": lambda w: revenue.revenue_share_by_plan(
        w.subscription_revenue, w.subscription_copies
    ),
    "m13_paying_subscriptions": lambda w: revenue.paying_subscriptions(w.subscription_revenue),
    "m14_top_subscriptions": lambda w: revenue.top_subscriptions(w.subscription_revenue),
    "m15_top_users": lambda w: engagement.top_users(w.engagement_per_user),
    "m16_listening_range": lambda w: engagement.listening_range(w.engagement_per_user),
    "m17_engagement_by_plan": lambda w: engagement.engagement_by_plan(
        w.engagement, w.dim_users, w.user_subscriptions
    ),
    "m18_engagement_by_status": lambda w: engagement.engagement_by_status(
        w.engagement, w.user_subscriptions, as_of=w.as_of
    ),
}

FIGURES: dict[str, Report] = {
    "k1_headline": lambda w: figures.headline(w.fct_payments, w.lives, as_of=w.as_of),
    "k2_revenue_two_routes": lambda w: figures.revenue_two_routes(
        w.fct_payments, w.subscription_copies, w.subscription_revenue
    ),
    "k3_churn_two_routes": lambda w: figures.churn_two_routes(
        w.marted, w.fct_subscriptions, as_of=w.as_of
    ),
    "k4_plan_page": lambda w: figures.plan_page(
        w.subscription_revenue,
        w.engagement,
        w.dim_users,
        w.user_subscriptions,
        as_of=w.as_of,
        copies=w.subscription_copies,
    ),
    "k5_summary_page": lambda w: figures.summary_page(
        w.subscription_revenue,
        w.fct_subscriptions,
        as_of=w.as_of,
        copies=w.subscription_copies,
        marted=w.marted,
    ),
}


def _row_counts(landing: Landing, w: Warehouse) -> DataFrame:
    """Rows of each feed, typed table and row-level mart, each counted as it is."""
    stripped = landing.stripped()
    return checks.row_counts(
        {
            "users_raw": stripped.users,
            "dim_users": w.dim_users,
            "subscriptions_raw": stripped.subscriptions,
            "fct_subscriptions": w.fct_subscriptions,
            "payments_raw": stripped.payments,
            "fct_payments": w.fct_payments,
            "listening_raw": stripped.listening,
            "bi_subscriptions": w.bi_subscriptions,
            "bi_payments": w.bi_payments,
            "bi_engagement": w.bi_engagement,
        }
    )


def _reject_counts(landing: Landing, w: Warehouse) -> DataFrame:
    return checks.row_counts(landing.rejects())


# Checks look at the landed text; previews and counts also at what became of it.
CHECKS: dict[str, Check] = {
    "s03_users_without_header": lambda raw, w: raw.stripped().users,
    "s03_subscriptions_without_header": lambda raw, w: raw.stripped().subscriptions,
    "s03_payments_without_header": lambda raw, w: raw.stripped().payments,
    "s03_listening_without_header": lambda raw, w: raw.stripped().listening,
    "q01_preview_users_landed": lambda raw, w: checks.preview_by(raw.users, 3, "user_id"),
    "q01_preview_users": lambda raw, w: checks.preview_by(w.dim_users, 5, "user_id"),
    "q01_preview_subscriptions_landed": lambda raw, w: checks.preview_by(
        raw.subscriptions, 3, "subscription_id"
    ),
    "q01_preview_subscriptions": lambda raw, w: checks.preview_by(
        w.fct_subscriptions, 5, "subscription_id"
    ),
    "q01_preview_payments_landed": lambda raw, w: checks.preview_by(
        raw.payments, 3, "payment_id"
    ),
    "q01_preview_payment_amounts": lambda raw, w: checks.preview(
        w.fct_payments, 10, "payment_id", "amount_cents", "amount", "payment_date"
    ),
    "q01_preview_payment_dates": lambda raw, w: checks.preview(
        w.fct_payments, 10, "payment_id", "amount", "payment_date"
    ),
    "q01_preview_payment_created": lambda raw, w: checks.preview(
        raw.stripped().payments, 20, "created_at"
    ),
    "q01_preview_listening_landed": lambda raw, w: checks.preview_by(
        raw.listening, 3, "history_id"
    ),
    "q02_row_counts": _row_counts,
    "q03_ids_not_digits": lambda raw, w: checks.ids_not_digits(raw.stripped().users),
    "q03_ids_not_digits_landed": lambda raw, w: checks.ids_not_digits(raw.users),
    "q04_amount_text_range": lambda raw, w: checks.amount_text_range(raw.stripped().payments),
    "q05_commonest_amount_texts": lambda raw, w: checks.commonest_amount_texts(
        raw.stripped().payments
    ),
    "q06_amount_range": lambda raw, w: checks.amount_range(raw.stripped().payments),
    "q07_commonest_amounts": lambda raw, w: checks.commonest_amounts(raw.stripped().payments),
    "q08_payments_at_offset": lambda raw, w: checks.payments_at_offset(
        raw.stripped().payments, OFFSET
    ),
    "q09_created_like_day": lambda raw, w: checks.created_like_day(raw.stripped().payments),
    "q10_churn_mart_display": lambda raw, w: w.bi_churn_tenure,
    "r1_reject_counts": _reject_counts,
}
