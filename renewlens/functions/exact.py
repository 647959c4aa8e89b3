"""Ratios rounded in whole numbers, so that ties fall the same way at any size."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and counts as decimals: products keep 38 digits instead of overflowing 64 bits.
WEIGHT_TYPE = "decimal(15,0)"
WHOLE_TYPE = "decimal(38,0)"


def rounded_quotient(numerator: Column, denominator: Column) -> Column:
    """Quotient with two digits, half rounded away from zero; null for a zero denominator.

    The quotient in hundredths is found by integer division after adding half the divisor,
    so no intermediate rounding can tip a tie.
    """
    divisor = denominator * 2
    hundredths = F.call_function(
        "div", F.abs(numerator) * 200 + denominator, F.nullif(divisor, divisor * 0)
    )
    signed = F.when(numerator < 0, -hundredths).otherwise(hundredths)
    return signed.cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def mean(total: Column, count: Column) -> Column:
    """Average of whole numbers."""
    return rounded_quotient(total.cast(WHOLE_TYPE), count.cast(WHOLE_TYPE)).cast("decimal(20,2)")


def percent(part: Column, whole: Column) -> Column:
    """Share of one count in another."""
    return rounded_quotient(part.cast(WHOLE_TYPE) * 100, whole.cast(WHOLE_TYPE)).cast(
        "decimal(7,2)"
    )


def money_per(amount: Column, count: Column) -> Column:
    """Average amount per counted thing."""
    return rounded_quotient(amount, count.cast("decimal(20,0)")).cast("decimal(20,2)")


def money_percent(part: Column, whole: Column) -> Column:
    """Share of one amount in another; a part may exceed the whole when others are negative."""
    return rounded_quotient(part * 100, whole).cast("decimal(20,2)")
