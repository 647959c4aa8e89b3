from renewlens.operators import checks, churn, figures, marts
from renewlens.plans.reports import CHECKS
from renewlens.plans.warehouse import Landing, Warehouse
from renewlens.sources import feeds

from .conftest import AS_OF, SMALL
from .helpers import payments, rows, subscriptions, text_frame
from .test_churn import LIVES


def _raw_payments(spark, found):
    return text_frame(
        spark,
        feeds.payments_feed(),
        [
            {"payment_id": str(i), "amount": amount, "payment_date": date, "created_at": created}
            for i, (amount, date, created) in enumerate(found)
        ],
    )


def test_previews_are_ordered(spark):
    frame = spark.createDataFrame([(3, "c"), (None, "n"), (1, "b"), (1, "a")], "k int, v string")
    assert rows(checks.preview_by(frame, 3, "k")) == [(1, "a"), (1, "b"), (3, "c")]
    assert rows(checks.preview(frame, 2, "v")) == [("a",), ("b",)]
    assert rows(checks.preview(frame, 9)) == [(1, "a"), (1, "b"), (3, "c"), (None, "n")]


def test_row_counts(spark):
    counts = checks.row_counts({"five": spark.range(5), "none": spark.range(0)})
    assert sorted(rows(counts)) == [("five", 5), ("none", 0)]
    assert rows(checks.row_count(spark.range(4), "users_rows")) == [(4,)]


def test_row_counts_notice_a_mart_that_loses_a_row(spark, monkeypatch):
    landing = Landing.from_standins(spark, SMALL)
    warehouse = Warehouse.from_landing(landing, as_of=AS_OF)

    def counted():
        return dict(rows(CHECKS["q02_row_counts"](landing, warehouse)))

    whole = counted()
    assert whole["bi_payments"] == warehouse.bi_payments.count()
    mart = marts.bi_subscriptions
    monkeypatch.setattr(
        marts, "bi_subscriptions", lambda *a, **k: mart(*a, **k).where("subscription_id <> 1")
    )
    assert counted() == whole | {"bi_subscriptions": whole["bi_subscriptions"] - 1}


def test_ids_not_digits(spark):
    feed = feeds.users_feed()
    ids = ["7", "x7", "", "7\n", " 7", None, "-1", "007"]
    raw = text_frame(spark, feed, [{"user_id": user} for user in ids])
    assert [r[0] for r in rows(checks.ids_not_digits(raw))] == ["", " 7", "-1", "7\n", "x7"]
    assert checks.ids_not_digits(raw, 2).count() == 2


def test_amounts_as_text_and_as_number(spark):
    raw = _raw_payments(
        spark,
        [("100", None, None), ("20", None, None), ("9", None, None), ("020", None, None),
         ("20", None, None), (None, None, None)],
    )
    assert rows(checks.amount_text_range(raw)) == [("020", "9")]
    assert rows(checks.amount_range(raw)) == [(9, 100)]
    assert rows(checks.commonest_amount_texts(raw, 3)) == [("20", 2), ("020", 1), ("100", 1)]
    assert rows(checks.commonest_amounts(raw, 2)) == [(20, 3), (9, 1)]


def test_offsets_are_found_in_either_field(spark):
    raw = _raw_payments(
        spark,
        [("1", "33:25.6", "a"), ("2", "01-01-2000", "33:25.6"), ("3", None, "33:25.6"),
         ("4", "33:25.6", None), ("5", None, None), ("6", "x", "33:25.60")],
    )
    found = checks.payments_at_offset(raw, "33:25.6")
    assert [row.amount for row in found.collect()] == ["1", "2", "3", "4"]
    assert checks.payments_at_offset(raw, "33:25.6", 2).count() == 2


def test_created_like_day_has_no_end_anchor(spark):
    raw = _raw_payments(
        spark,
        [("1", None, "01-02-2024"), ("1", None, "01-02-2024 10:00"), ("1", None, "1-2-2024"),
         ("1", None, " 01-02-2024"), ("1", None, None)],
    )
    assert rows(checks.created_like_day(raw)) == [(2,)]


def test_headline_and_two_route_churn(spark, today):
    subs = subscriptions(spark, LIVES)
    pay = payments(spark, [(1, 100), (77, 50)])
    (row,) = figures.headline(pay, subs, as_of=today).collect()
    assert (row.total_subscriptions, float(row.churn_rate_percent), float(row.total_revenue)) == (
        10, 60.0, 1.5,
    )
    marted = marts.bi_subscriptions(subs, as_of=today)
    compared = figures.churn_two_routes(marted, subs, as_of=today).collect()
    assert {row.tenure_bucket: (row.direct_total, row.direct_churned) for row in compared} == {
        row.tenure_bucket: (row.total_subscriptions, row.churned_subscriptions)
        for row in marts.bi_churn_tenure(marted).collect()
    }
    assert all(row.total_difference == row.churned_difference == 0 for row in compared)


def test_headline_of_empty_inputs(spark, today):
    subs, pay = subscriptions(spark, LIVES).limit(0), payments(spark, [(1, 1)]).limit(0)
    assert rows(figures.headline(pay, subs, as_of=today)) == [(0, None, None)]


def test_two_routes_show_a_difference(spark):
    """Cents and money that disagree must surface."""
    from pyspark.sql import functions as F

    pay = payments(spark, [(1, 100), (2, 300)]).withColumn(
        "amount_cents", F.when(F.col("subscription_id") == 2, 200).otherwise(F.col("amount_cents"))
    )
    subs = subscriptions(spark, [(1, 1, "A", None, None), (2, 1, None, None, None)])
    found = [(r[0], float(r[1]), float(r[2]), float(r[3])) for r in rows(figures.revenue_two_routes(pay, subs))]
    assert found == [("A", 1.0, 1.0, 0.0), (None, 3.0, 2.0, 1.0)]


def test_summary_page_agrees_with_its_parts(spark, today):
    subs = subscriptions(spark, LIVES)
    pay = payments(spark, [(1, 100), (4, 300), (77, 50)])
    page = {
        (row.panel, row.label, row.figure): row.value
        for row in figures.summary_page(pay, subs, as_of=today).collect()
    }
    assert page[("headline", "all", "total_subscriptions")] == 10
    assert page[("headline", "all", "total_revenue")] == 4.5
    assert page[("revenue by plan", "B", "revenue_share_percent")] == 75
    for plan, rate in rows(churn.churn_rate_by_plan(subs, as_of=today)):
        assert page[("churn rate by plan", plan, "churn_rate")] == float(rate)
    mart = marts.bi_churn_tenure(marts.bi_subscriptions(subs, as_of=today)).collect()
    for row in mart:
        assert page[("churn by tenure", row[0], "total_subscriptions")] == row[1]
        assert page[("churn by tenure", row[0], "churn_rate_percent")] == float(row[3])
    assert len([key for key in page if key[0] == "churn by tenure"]) == 3 * len(mart)
