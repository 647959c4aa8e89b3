"""Small frames and comparisons for the tests."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

SUBSCRIPTION = (
    "row_id string, subscription_id bigint, user_id bigint, subscription_type string, "
    "start_date date, end_date date, created_at string"
)
PAYMENT = (
    "row_id string, payment_id bigint, user_id bigint, subscription_id bigint, "
    "amount_cents int, amount decimal(12,2), payment_date date, payment_method string, "
    "created_at string"
)
USER = "row_id string, user_id bigint, subscription_type string"
ENGAGEMENT = "user_id bigint, total_listens bigint"


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


def subscriptions(spark, rows):
    """Rows of (subscription_id, user_id, plan, start, end) with ISO dates."""
    full = [
        (str(i), sub, user, plan, day(start), day(end), "33:25.6")
        for i, (sub, user, plan, start, end) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SUBSCRIPTION)


def payments(spark, rows):
    """Rows of (subscription_id, cents)."""
    full = [
        (
            str(i), i, None, sub, cents,
            None if cents is None else Decimal(cents) / 100,
            None, "card", "24:52.6",
        )
        for i, (sub, cents) in enumerate(rows)
    ]
    return spark.createDataFrame(full, PAYMENT)


def users(spark, ids):
    return spark.createDataFrame([(str(i), user, "x") for i, user in enumerate(ids)], USER)


def engagement(spark, rows):
    return spark.createDataFrame(rows, ENGAGEMENT)


def text_frame(spark, feed, rows):
    """Rows given as dicts; columns left out are null."""
    return spark.createDataFrame(
        [tuple(row.get(column) for column in feed.columns) for row in rows], feed.schema
    )


def rows(df):
    return [tuple(row) for row in df.collect()]


def half_up(value, digits=2):
    return Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)


def same_rows(left, left_names, right, right_names):
    """Compare two lists of rows regardless of row and column order."""
    assert sorted(left_names) == sorted(right_names)
    order = sorted(left_names)

    def arranged(data, names):
        places = [names.index(name) for name in order]
        return sorted((tuple(row[place] for place in places) for row in data), key=repr)

    assert arranged(left, list(left_names)) == arranged(right, list(right_names))


def final_plan(df):
    """Physical plan text after adaptive execution has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
