"""Status, tenure and tenure bucket of a subscription as of a given day.

All builders take columns and the reference day as a column, so one plan can be reused for
any day and a run is repeatable.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound in days and label of each tenure bucket, in order.
BOUNDED_BUCKETS = (
    (30, "0-30 days"),
    (90, "31-90 days"),
    (180, "91-180 days"),
    (365, "181-365 days"),
)
# The mart and the churn metrics name the open bucket differently.
MART_LAST_BUCKET = "365+ days"
METRIC_LAST_BUCKET = "366+ days"

# Names of the two sides of the status split.
ACTIVE = "Active"
CHURNED = "Churned"


def as_of_day(as_of: dt.date | str | Column | None) -> Column:
    """Reference day as a column. ``None`` means today; pass a day for repeatable results."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def is_churned(end: Column, as_of: Column) -> Column:
    """Ended before the reference day. Never null, and a form that Parquet scans can filter by."""
    return end.isNotNull() & (end < as_of)


def is_running(end: Column, as_of: Column) -> Column:
    """Loose activity, the complement of churned: a future start counts as running."""
    return end.isNull() | (end >= as_of)


def is_active(start: Column, end: Column, as_of: Column) -> Column:
    """Strict activity: started and not churned. Unknown start gives null unless churned."""
    return (start <= as_of) & is_running(end, as_of)


def status_label(end: Column, as_of: Column) -> Column:
    return F.when(is_churned(end, as_of), CHURNED).otherwise(ACTIVE)


def tenure_days(start: Column, end: Column, as_of: Column) -> Column:
    """Days from start to the earlier of end and reference day (``least`` skips a null end)."""
    return F.datediff(F.least(end, as_of), start)


def bucket(days: Column, last_label: str) -> Column:
    """Bucket label. Null days fall into the last bucket, negative days into the first."""
    (bound, label), *rest = BOUNDED_BUCKETS
    chain = F.when(days <= bound, label)
    for bound, label in rest:
        chain = chain.when(days <= bound, label)
    return chain.otherwise(last_label)
