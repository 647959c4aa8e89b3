"""Sort order with nulls as the largest value, stated rather than left to engine defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def largest_first(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def smallest_first(name: str) -> Column:
    return F.col(name).asc_nulls_last()
