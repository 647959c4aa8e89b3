from renewlens.operators import churn, marts

from .helpers import half_up, rows, subscriptions

LIVES = [
    # id, user, plan, start, end (reference day 2000-01-01)
    (1, 1, "A", "1999-01-01", None),
    (2, 1, "A", "1999-01-01", "1999-01-11"),
    (3, 2, "A", "2001-01-01", None),
    (4, 2, "B", "1998-01-01", "1999-06-01"),
    (5, 3, "B", None, "1999-12-31"),
    (6, 3, "B", None, None),
    (7, 4, None, "1999-11-01", "2000-01-01"),
    (8, 4, None, "1999-11-01", "1999-12-31"),
    (9, 5, "C", "1999-12-01", "1999-11-01"),
    (10, 5, "C", "1999-10-01", "1999-12-01"),
]


def test_active(spark, today):
    subs = subscriptions(spark, LIVES)
    assert rows(churn.active_subscriptions(subs, as_of=today)) == [(2,)]
    # Equal counts are ordered by plan, with the unnamed plan last.
    assert rows(churn.active_by_plan(subs, as_of=today)) == [("A", 1), (None, 1)]


def test_totals_and_churned(spark, today):
    subs = subscriptions(spark, LIVES)
    assert rows(churn.total_by_plan(subs)) == [("A", 3), ("B", 3), ("C", 2), (None, 2)]
    named = [("B", 2), ("C", 2), ("A", 1), (None, 1)]
    assert rows(churn.churned_by_plan(subs, as_of=today)) == named
    assert rows(churn.churned_counts(subs, as_of=today)) == [(n,) for _, n in named]


def test_rates(spark, today):
    subs = subscriptions(spark, LIVES)
    third, two_thirds = half_up("33.33"), half_up("66.67")
    assert rows(churn.churn_rate_by_plan(subs, as_of=today)) == [
        ("C", half_up(100)), ("B", two_thirds), (None, half_up(50)), ("A", third),
    ]
    # Loose activity: the subscription that has not started yet counts as running.
    assert rows(churn.status_rates_by_plan(subs, as_of=today)) == [
        ("A", two_thirds, third),
        ("B", third, two_thirds),
        ("C", half_up(0), half_up(100)),
        (None, half_up(50), half_up(50)),
    ]


def test_buckets(spark, today):
    subs = subscriptions(spark, LIVES)
    assert rows(churn.churned_by_bucket(subs, as_of=today)) == [
        ("0-30 days", 2), ("31-90 days", 2), ("366+ days", 2),
    ]
    assert rows(churn.churned_by_plan_and_bucket(subs, as_of=today)) == [
        ("A", "0-30 days", 1),
        ("B", "366+ days", 2),
        ("C", "0-30 days", 1),
        ("C", "31-90 days", 1),
        (None, "31-90 days", 1),
    ]


def test_mart_and_metric_name_the_last_bucket_differently(spark, today):
    subs = subscriptions(spark, LIVES)
    mart = marts.bi_churn_tenure(marts.bi_subscriptions(subs, as_of=today))
    # Rows without a start are in no mart bucket; an empty bucket has no row.
    assert rows(mart) == [
        ("0-30 days", 3, 2, half_up("66.67")),
        ("31-90 days", 3, 2, half_up("66.67")),
        ("181-365 days", 1, 0, half_up(0)),
        ("365+ days", 1, 1, half_up(100)),
    ]


def test_empty_input(spark, today):
    subs = subscriptions(spark, LIVES).limit(0)
    assert rows(churn.active_subscriptions(subs, as_of=today)) == [(0,)]
    assert rows(churn.churned_by_bucket(subs, as_of=today)) == []
    assert rows(marts.bi_churn_tenure(marts.bi_subscriptions(subs, as_of=today))) == []
