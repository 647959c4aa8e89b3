import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from renewlens.functions import lifecycle
from renewlens.functions.exact import mean, money_per, money_percent, percent
from renewlens.operators import marts

from .conftest import AS_OF
from .helpers import half_up, subscriptions

ONE = dt.timedelta(days=1)


def _iso(day):
    return None if day is None else day.isoformat()


def _mart(spark, lives):
    """lives: list of (start, end) dates; returns mart rows by position."""
    frame = subscriptions(
        spark, [(i, i, "p", _iso(start), _iso(end)) for i, (start, end) in enumerate(lives)]
    )
    found = marts.bi_subscriptions(frame, as_of=F.lit(AS_OF)).collect()
    return [row for row in sorted(found, key=lambda row: row.subscription_id)]


@pytest.mark.parametrize(
    "start, end, active, churned",
    [
        (AS_OF - ONE, AS_OF, True, False),
        (AS_OF - ONE, AS_OF - ONE, False, True),
        (AS_OF, None, True, False),
        (AS_OF + ONE, None, False, False),
        (AS_OF + ONE, AS_OF - ONE, False, True),
        (None, None, None, False),
        (None, AS_OF, None, False),
        (None, AS_OF - ONE, False, True),
    ],
)
def test_status(spark, start, end, active, churned):
    (row,) = _mart(spark, [(start, end)])
    assert (row.is_active, row.is_churned) == (active, churned)


@pytest.mark.parametrize(
    "tenure, label",
    [
        (-1, "0-30 days"), (0, "0-30 days"), (30, "0-30 days"), (31, "31-90 days"),
        (90, "31-90 days"), (91, "91-180 days"), (180, "91-180 days"), (181, "181-365 days"),
        (365, "181-365 days"), (366, "365+ days"), (5000, "365+ days"),
    ],
)
def test_mart_bucket_edges(spark, tenure, label):
    span = dt.timedelta(days=tenure)
    open_ended, ended = _mart(spark, [(AS_OF - span, None), (AS_OF - ONE - span, AS_OF - ONE)])
    assert (open_ended.tenure_days, open_ended.tenure_bucket) == (tenure, label)
    assert (ended.tenure_days, ended.tenure_bucket) == (tenure, label)


def test_tenure_ends_at_the_reference_day(spark):
    today, later, unknown = _mart(
        spark, [(AS_OF - 9 * ONE, AS_OF), (AS_OF - 9 * ONE, AS_OF + 50 * ONE), (None, AS_OF - ONE)]
    )
    assert today.tenure_days == later.tenure_days == 9
    assert (unknown.tenure_days, unknown.tenure_bucket) == (None, None)


def test_metric_bucket_puts_unknown_length_last(spark):
    days = spark.createDataFrame([(None,), (366,), (365,), (-5,)], "days int")
    found = days.select(lifecycle.bucket(F.col("days"), lifecycle.METRIC_LAST_BUCKET)).collect()
    assert [row[0] for row in found] == ["366+ days", "366+ days", "181-365 days", "0-30 days"]


def test_mart_against_brute_force(spark):
    rng = random.Random(7)

    def some_day():
        return None if rng.random() < 0.15 else AS_OF + rng.randint(-450, 60) * ONE

    lives = [(some_day(), some_day()) for _ in range(2000)]
    for (start, end), row in zip(lives, _mart(spark, lives), strict=True):
        churned = end is not None and end < AS_OF
        last = end if churned else AS_OF
        tenure = None if start is None else (last - start).days
        assert row.is_churned == churned
        if start is None:
            assert row.is_active is (False if churned else None)
        else:
            assert row.is_active == (start <= AS_OF and not churned)
        assert row.tenure_days == tenure
        if tenure is None:
            assert row.tenure_bucket is None
        else:
            edges = [(30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days"), (365, "181-365 days")]
            assert row.tenure_bucket == next((n for b, n in edges if tenure <= b), "365+ days")


def test_reference_day_forms(spark):
    frame = spark.range(1)
    forms = [AS_OF, "2000-01-01", F.lit(AS_OF)]
    found = frame.select(*[lifecycle.as_of_day(form) for form in forms]).collect()[0]
    assert set(found) == {AS_OF}
    spread = frame.select(lifecycle.as_of_day(None), F.current_date()).collect()[0]
    assert spread[0] == spread[1]


def test_ratios_round_half_away_from_zero(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 10**6), rng.randint(1, 10**6)) for _ in range(500)]
    pairs += [(1, 800), (3, 800), (956, 1020), (1, 3), (0, 5), (10**15, 3 * 10**15)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    found = frame.select("a", "b", mean(a, b).alias("mean"), percent(a, b).alias("percent"))
    from fractions import Fraction

    for row in found.collect():
        exact = Fraction(row.a, row.b)
        hundredths = (exact * 100 * 2 + 1) // 2
        assert row.mean * 100 == hundredths
        assert row.percent * 100 == (exact * 10000 * 2 + 1) // 2


def test_money_ratios(spark):
    frame = spark.sql(
        "SELECT CAST(a AS decimal(38,2)) AS a, CAST(b AS decimal(38,2)) AS b, n FROM VALUES "
        "(10.05, 20.10, 2), (-10.05, 20.10, 2), (NULL, 1.00, 1), (5.00, 0.00, 0) AS t(a, b, n)"
    )
    found = frame.select(
        money_per(F.col("a"), F.col("n")), money_percent(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(row) for row in found] == [
        (half_up("5.03"), half_up("50")),
        (half_up("-5.03"), half_up("-50")),
        (None, None),
        (None, None),
    ]


def test_zero_denominator_gives_null(spark):
    frame = spark.createDataFrame([(1, 0)], "a bigint, b bigint")
    assert tuple(frame.select(percent(F.col("a"), F.col("b")), mean(F.col("a"), F.col("b"))).first()) == (
        None, None,
    )


def test_published_rate_arithmetic(spark):
    """Counts and rates of the published churn mart, shortest tenure first."""
    published = [
        ("0-30 days", 931, 931, "100.00"),
        ("31-90 days", 957, 957, "100.00"),
        ("91-180 days", 976, 976, "100.00"),
        ("181-365 days", 1020, 956, "93.73"),
    ]
    first = {"0-30 days": 10, "31-90 days": 31, "91-180 days": 100, "181-365 days": 200}
    lives = []
    for label, total, churned, _ in published:
        span = dt.timedelta(days=first[label])
        lives += [(AS_OF - ONE - span, AS_OF - ONE)] * churned
        lives += [(AS_OF - span, None)] * (total - churned)
    frame = subscriptions(spark, [(i, i, "p", _iso(s), _iso(e)) for i, (s, e) in enumerate(lives)])
    mart = marts.bi_churn_tenure(marts.bi_subscriptions(frame, as_of=F.lit(AS_OF)))
    assert mart.columns == [
        "tenure_bucket", "total_subscriptions", "churned_subscriptions", "churn_rate_percent",
    ]
    found = [(r[0], r[1], r[2], str(r[3])) for r in mart.collect()]
    assert found == published
