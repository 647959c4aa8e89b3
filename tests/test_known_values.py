"""Results on the medium tables that were worked out beforehand, and identities between them."""

import pytest

from renewlens.operators import churn
from renewlens.plans.reports import METRICS
from renewlens.plans.warehouse import Landing, Warehouse

from .conftest import AS_OF, MEDIUM
from .helpers import rows


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("typed") / "tables")
    Warehouse.from_landing(Landing.from_standins(spark, MEDIUM), as_of=AS_OF).save_parquet(folder)
    return Warehouse.from_parquet(spark, folder, as_of=AS_OF)


@pytest.fixture(scope="module")
def metric(warehouse):
    return lambda name: [
        tuple(value if isinstance(value, (str, int, type(None))) else float(value) for value in row)
        for row in METRICS[name](warehouse).collect()
    ]


def test_churn_mart(warehouse):
    assert [row[:3] for row in rows(warehouse.bi_churn_tenure)] == [
        ("0-30 days", 4587, 748),
        ("31-90 days", 1217, 856),
        ("91-180 days", 1640, 1189),
        ("181-365 days", 2969, 2252),
        ("365+ days", 4571, 1474),
    ]


def test_status_flags(warehouse):
    found = warehouse.bi_subscriptions.groupBy("is_active", "is_churned").count()
    assert {row[:2]: row[2] for row in rows(found)} == {
        (None, False): 9, (False, False): 3653, (False, True): 6526, (True, False): 4812,
    }


def test_churn_metrics(metric):
    assert metric("m01_active_subscriptions") == [(4812,)]
    assert metric("m06_status_rates_by_plan") == [
        ("1-URGENT", 56.31, 43.69),
        ("2-HIGH", 56.34, 43.66),
        ("3-MEDIUM", 57.58, 42.42),
        ("4-NOT SPECIFIED", 55.89, 44.11),
        ("5-LOW", 56.34, 43.66),
    ]
    assert metric("m07_churned_by_bucket") == [
        ("0-30 days", 748),
        ("31-90 days", 856),
        ("91-180 days", 1189),
        ("181-365 days", 2252),
        ("366+ days", 1481),
    ]


def test_revenue_metrics(metric):
    assert metric("m09_total_revenue") == [(3183256271.63,)]
    assert {(row[0], row[2]) for row in metric("m12_revenue_share_by_plan")} == {
        ("3-MEDIUM", 20.24), ("5-LOW", 20.08), ("4-NOT SPECIFIED", 20.07), ("2-HIGH", 20.07),
        ("1-URGENT", 19.54),
    }
    assert [row[2] for row in metric("m11_revenue_per_paying_subscription")] == [
        2951, 2946, 2954, 2962, 2930,
    ]
    assert metric("m14_top_subscriptions")[:3] == [
        (4336, 753168.05), (2842, 747260.99), (14275, 730454.05),
    ]


def test_engagement_metrics(metric):
    assert metric("m15_top_users") == [
        (149, 86), (41, 85), (89, 85), (90, 84), (17, 83),
        (65, 82), (7, 81), (75, 81), (128, 81), (12, 80),
    ]
    assert metric("m16_listening_range") == [(49, 86, 66.67)]
    assert sorted(metric("m17_engagement_by_plan")) == [
        ("1-URGENT", 128, 66.05, 85),
        ("2-HIGH", 127, 66.65, 86),
        ("3-MEDIUM", 131, 66.8, 86),
        ("4-NOT SPECIFIED", 123, 66.8, 86),
        ("5-LOW", 127, 66.62, 86),
    ]
    assert metric("m18_engagement_by_status") == [
        ("Active", 149, 66.56, 86), ("Churned", 148, 66.62, 86),
    ]


def test_identities(warehouse, metric):
    subs = warehouse.fct_subscriptions
    every = subs.count()
    no_start = subs.where("start_date IS NULL").count()
    churned = sum(n for _, n in metric("m07_churned_by_bucket"))
    assert sum(n for _, n in metric("m02_active_by_plan")) == metric("m01_active_subscriptions")[0][0]
    assert sum(n for _, n in metric("m03_total_by_plan")) == every
    assert sum(row[1] for row in rows(warehouse.bi_churn_tenure)) + no_start == every
    assert all(abs(a + c - 100) <= 0.01 + 1e-9 for _, a, c in metric("m06_status_rates_by_plan"))
    assert sum(n for (n,) in metric("m04_churned_counts")) == churned
    by_bucket = dict(metric("m07_churned_by_bucket"))
    for bucket, total in by_bucket.items():
        parts = [n for _, b, n in metric("m08_churned_by_plan_and_bucket") if b == bucket]
        assert sum(parts) == total
    ids = churn.churned_by_plan(subs, as_of=warehouse.as_of)
    assert sum(n for _, n in rows(ids)) == churned
    whole = metric("m09_total_revenue")[0][0]
    assert sum(r for _, r in metric("m10_revenue_by_plan")) == pytest.approx(whole, abs=0.01)
    assert sum(s for *_, s in metric("m12_revenue_share_by_plan")) == pytest.approx(100, abs=0.05)
    assert metric("m13_paying_subscriptions")[0][1] == whole
