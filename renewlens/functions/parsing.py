"""Turn text fields into typed columns without ever failing a job on a bad value.

Every parse uses a ``try_`` form. Spark may evaluate a cast on rows a later filter would
drop, so a strict cast could stop a job because of a header row nobody asked for. A value
that is present but does not parse is *malformed*; the feeds module sets such rows aside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the feeds.
OPEN_ENDED = "NULL"
DAY_FORMAT = "d-M-yyyy"
ALL_DIGITS = r"^[0-9]+\z"
FULL_DAY = r"^[0-9]{2}-[0-9]{2}-[0-9]{4}\z"
STARTS_LIKE_DAY = r"^[0-9]{2}-[0-9]{2}-[0-9]{4}"

# Ids are 64 bits wide so that a feed with more than 2^31 rows stays whole.
ID_TYPE = "bigint"
MONEY_TYPE = "decimal(12,2)"


@dataclass(frozen=True)
class Rule:
    """How one text field becomes a typed value.

    ``typed`` builds the value. ``exempt`` marks present values whose typed form is null on
    purpose, so that they are not reported as malformed.
    """

    expects: str
    typed: Callable[[Column], Column]
    exempt: Callable[[Column], Column] | None = None

    def malformed(self, text: Column) -> Column:
        """The parse comes first: on a good value it alone decides, and it runs once."""
        lost = self.typed(text).isNull() & text.isNotNull()
        return lost if self.exempt is None else lost & ~self.exempt(text)


def _day(text: Column) -> Column:
    """Parsing passes through the session time zone; in UTC every calendar day exists."""
    return F.try_to_date(text, DAY_FORMAT)


def integer(width: str = ID_TYPE) -> Rule:
    return Rule(f"a whole number ({width})", lambda text: text.try_cast(width))


def day() -> Rule:
    return Rule("a day-month-year date", _day)


def day_or_open() -> Rule:
    """A date, or the word that marks an open-ended period."""
    return Rule(
        f"a day-month-year date or {OPEN_ENDED}",
        lambda text: F.when(text != OPEN_ENDED, _day(text)),
        lambda text: text == OPEN_ENDED,
    )


def day_if_shaped() -> Rule:
    """A date where the text has the full shape of one; any other text is an offset, hence null."""
    return Rule(
        "a real date where the text looks like one",
        lambda text: F.when(text.rlike(FULL_DAY), _day(text)),
        lambda text: ~text.rlike(FULL_DAY),
    )


def cents_to_money(cents: Column) -> Column:
    """Exact amount of a whole number of cents; stays within 18 digits, Spark's fast decimals."""
    return (cents.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast(MONEY_TYPE)
