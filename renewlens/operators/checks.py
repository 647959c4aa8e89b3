"""Data checks on landed text and on typed tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.functions.ordering import largest_first, smallest_first
from renewlens.functions.parsing import ALL_DIGITS, STARTS_LIKE_DAY, integer


def preview(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """First rows in ascending order of the columns shown (all if none are named)."""
    shown = df.select(*columns) if columns else df
    return shown.orderBy(*[smallest_first(name) for name in shown.columns]).limit(n)


def preview_by(df: DataFrame, n: int, key: str) -> DataFrame:
    """First rows by a key column, whole rows; the other columns decide between equal keys."""
    others = [name for name in df.columns if name != key]
    return df.orderBy(*[smallest_first(name) for name in (key, *others)]).limit(n)


def row_count(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def row_counts(relations: Mapping[str, DataFrame]) -> DataFrame:
    """One row per relation with its number of rows."""
    return reduce(
        DataFrame.unionByName,
        [
            row_count(df).select(F.lit(name).alias("relation"), "rows")
            for name, df in relations.items()
        ],
    )


def ids_not_digits(raw: DataFrame, n: int = 20) -> DataFrame:
    """User ids with anything but digits. A null id is not reported."""
    odd = raw.where(~F.col("user_id").rlike(ALL_DIGITS))
    return odd.select("user_id").orderBy(smallest_first("user_id")).limit(n)


def amount_text_range(payments_raw: DataFrame) -> DataFrame:
    """Smallest and largest amount in text order, byte by byte."""
    return payments_raw.agg(
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount")
    )


def amount_range(payments_raw: DataFrame) -> DataFrame:
    cents = integer("int").typed(F.col("amount"))
    return payments_raw.agg(
        F.min(cents).alias("min_amount_int"), F.max(cents).alias("max_amount_int")
    )


def _commonest(df: DataFrame, key: str, n: int) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("cnt"))
        .orderBy(largest_first("cnt"), smallest_first(key))
        .limit(n)
    )


def commonest_amount_texts(payments_raw: DataFrame, n: int = 15) -> DataFrame:
    return _commonest(payments_raw.select("amount"), "amount", n)


def commonest_amounts(payments_raw: DataFrame, n: int = 15) -> DataFrame:
    cents = integer("int").typed(F.col("amount")).alias("amount_int")
    return _commonest(payments_raw.select(cents), "amount_int", n)


def payments_at_offset(payments_raw: DataFrame, offset: str, n: int = 5) -> DataFrame:
    """Payments whose date or creation field holds the given offset, compared as text."""
    at_offset = (F.col("payment_date") == offset) | (F.col("created_at") == offset)
    return preview_by(payments_raw.where(at_offset), n, "payment_id")


def created_like_day(payments_raw: DataFrame) -> DataFrame:
    """How many creation fields begin like a date; what follows does not matter."""
    return payments_raw.agg(
        F.count_if(F.col("created_at").rlike(STARTS_LIKE_DAY)).alias("looks_like_date")
    )
