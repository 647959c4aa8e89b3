"""The physical plans: what is scanned, shuffled and joined, and what a hot key does to them."""

import re

import pytest

import __spark_entry__ as entry
from renewlens.operators import figures, marts
from renewlens.plans.reports import CHECKS, FIGURES, METRICS, RELATIONS
from renewlens.plans.warehouse import Landing, Warehouse

from .conftest import AS_OF, SMALL
from .helpers import final_plan, initial_plan, payments, subscriptions

REPORTS = {**RELATIONS, **METRICS, **FIGURES}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("typed") / "tables")
    Warehouse.from_landing(Landing.from_standins(spark, SMALL), as_of=AS_OF).save_parquet(folder)
    return Warehouse.from_parquet(spark, folder, as_of=AS_OF)


@pytest.fixture(scope="module")
def uncollapsed(stored):
    """Typed tables without the stored sums per subscription."""
    return Warehouse(*stored.typed_tables().values(), AS_OF)


@pytest.mark.parametrize("name", sorted({**REPORTS, **CHECKS}))
def test_no_python_and_no_product(name, spark, setting):
    setting(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = initial_plan(entry.queries()[name](spark, SMALL))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "InPandas"):
        assert node not in plan


def _scanned(plan):
    """Columns read from each Parquet scan."""
    return [set(re.findall(r"(\w+)#\d+", cols)) for cols in re.findall(r"FileScan parquet [\w.]*\[([^\]]*)\]", plan)]


@pytest.mark.parametrize(
    "name, columns",
    [
        ("m01_active_subscriptions", [{"start_date", "end_date"}]),
        ("m03_total_by_plan", [{"subscription_type"}]),
        ("m06_status_rates_by_plan", [{"subscription_type", "end_date"}]),
        ("m08_churned_by_plan_and_bucket", [{"subscription_type", "start_date", "end_date"}]),
        ("v8_bi_churn_tenure", [{"start_date", "end_date"}]),
        ("m09_total_revenue", [{"amount"}]),
        ("m10_revenue_by_plan", [{"subscription_id", "amount"}, {"subscription_id", "subscription_type"}]),
        ("m13_paying_subscriptions", [{"subscription_id", "amount"}]),
        (
            "m17_engagement_by_plan",
            [{"user_id", "total_listens"}, {"user_id"}, {"user_id", "subscription_type"}],
        ),
    ],
)
def test_each_input_is_scanned_once_and_pruned(uncollapsed, name, columns):
    assert _scanned(initial_plan(REPORTS[name](uncollapsed))) == columns


@pytest.mark.parametrize(
    "name, columns",
    [
        ("m01_active_subscriptions", [{"is_active", "subscriptions", "as_of"}]),
        ("m06_status_rates_by_plan", [{"subscription_type", "is_churned", "subscriptions", "as_of"}]),
        ("m13_paying_subscriptions", [{"subscription_id", "subscription_revenue"}]),
        (
            "m10_revenue_by_plan",
            [
                {"subscription_id", "subscription_revenue"},
                {"subscription_id", "subscription_type", "copies"},
            ],
        ),
        (
            "m17_engagement_by_plan",
            [
                {"user_id", "engagement_rows", "listens", "most_listens", "user_rows"},
                {"user_id", "subscription_type", "subscription_rows"},
            ],
        ),
        (
            "m18_engagement_by_status",
            [
                {"user_id", "engagement_rows", "listens", "most_listens"},
                {"user_id", "end_date", "subscription_rows"},
            ],
        ),
    ],
)
def test_stored_sums_are_scanned_once_and_pruned(stored, name, columns):
    assert _scanned(initial_plan(REPORTS[name](stored))) == columns


def _runs_of_scan(plan, table):
    """Scans of a table in the parts of a plan that were run; a reused shuffle is not run again."""
    ran, skipped = [], None
    for line in plan.splitlines():
        place = len(line) - len(line.lstrip(" :+-*"))
        if skipped is None or place < skipped:
            skipped = place if "== Initial Plan ==" in line else None
            ran.append(line)
    return len(re.findall(rf"FileScan [^\n]*/{table}\]", "\n".join(ran)))


@pytest.mark.parametrize("name", ["m12_revenue_share_by_plan", "k5_summary_page"])
def test_shares_need_no_window_over_all_plans(stored, name):
    plan = initial_plan(REPORTS[name](stored))
    assert "Window [" not in plan and "Subquery subquery" in plan


def test_total_and_shares_share_their_scans(uncollapsed, setting):
    setting(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__maxMetadataStringLength="2000",
    )
    plan = final_plan(METRICS["m12_revenue_share_by_plan"](uncollapsed))
    assert _runs_of_scan(plan, "fct_payments") == _runs_of_scan(plan, "fct_subscriptions") == 1


def test_date_filters_reach_the_scan(uncollapsed):
    churned = initial_plan(METRICS["m07_churned_by_bucket"](uncollapsed))
    assert "IsNotNull(end_date), LessThan(end_date,2000-01-01)" in churned
    active = initial_plan(METRICS["m01_active_subscriptions"](uncollapsed))
    assert "LessThanOrEqual(start_date,2000-01-01)" in active
    assert "Or(IsNull(end_date),GreaterThanOr" in active


@pytest.mark.parametrize(
    "name", ["m10_revenue_by_plan", "m11_revenue_per_paying_subscription", "m12_revenue_share_by_plan",
             "m17_engagement_by_plan", "m18_engagement_by_status"]
)
def test_keys_are_collapsed_below_every_shuffle_of_rows(uncollapsed, setting, name):
    """No exchange carries single rows: each has an aggregate right below it."""
    setting(spark__sql__autoBroadcastJoinThreshold="-1")
    lines = initial_plan(METRICS[name](uncollapsed)).splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges
    for i in exchanges:
        assert "HashAggregate" in lines[i + 1], lines[i + 1]


@pytest.mark.parametrize(
    "name", ["m10_revenue_by_plan", "m11_revenue_per_paying_subscription", "m12_revenue_share_by_plan"]
)
def test_stored_buckets_are_joined_without_a_shuffle(spark, stored, setting, name):
    setting(spark__sql__autoBroadcastJoinThreshold="-1")
    stored.save_tables(spark, "bucketed")
    saved = Warehouse.from_tables(spark, "bucketed", as_of=AS_OF)
    plan = initial_plan(METRICS[name](saved))
    assert "SortMergeJoin" in plan
    assert "hashpartitioning(subscription_id" not in plan


@pytest.mark.parametrize(
    "name, table, scans",
    [
        ("k4_plan_page", "fct_payments", 1),
        # Copies per subscription, and one count that serves both panels of engagement.
        ("k4_plan_page", "fct_subscriptions", 2),
        ("k4_plan_page", "engagement_per_user", 1),
    ],
)
def test_report_pages_share_their_scans(uncollapsed, setting, name, table, scans):
    setting(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    plan = final_plan(FIGURES[name](uncollapsed)).split("== Initial Plan ==")[0]
    assert len(re.findall(rf"FileScan [^\n]*/{table}\]", plan)) == scans


@pytest.mark.parametrize(
    "name",
    ["m10_revenue_by_plan", "m13_paying_subscriptions", "m14_top_subscriptions", "k4_plan_page", "k5_summary_page"],
)
def test_reports_over_stored_sums_read_no_payments(stored, name):
    plan = initial_plan(REPORTS[name](stored))
    assert "/subscription_revenue]" in plan
    assert "/fct_payments]" not in plan


@pytest.mark.parametrize("name", ["m14_top_subscriptions", "m15_top_users"])
def test_top_lists_keep_ten_rows_per_task(stored, name):
    assert "TakeOrderedAndProject" in initial_plan(METRICS[name](stored))


def test_hot_subscription_is_split_in_the_row_joins(spark, setting):
    """A third of the payments share one subscription: adaptive execution splits its partition.

    In the payments mart, and in the first of the two routes to revenue by plan.
    """
    setting(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2k",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1k",
        spark__sql__shuffle__partitions="16",
    )
    pay = payments(spark, [(7 if i % 3 == 0 else i, i) for i in range(6000)]).repartition(8)
    subs = subscriptions(spark, [(i, i, "AB"[i % 2], None, None) for i in range(6000)])
    joined = marts.bi_payments(pay, subs.repartition(4))
    plan = final_plan(joined)
    assert "SortMergeJoin(skew=true)" in plan
    assert joined.count() == 6000
    routes = figures.revenue_two_routes(pay, subs.repartition(4))
    assert "SortMergeJoin(skew=true)" in final_plan(routes)
    sums = {plan: sum(i for i in range(6000) if "AB"[(7 if i % 3 == 0 else i) % 2] == plan) for plan in "AB"}
    found = {row.subscription_type: row for row in routes.collect()}
    assert {name: row.joined_revenue * 100 for name, row in found.items()} == sums
    assert {row.difference for row in found.values()} == {0}
