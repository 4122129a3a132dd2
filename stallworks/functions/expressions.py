"""Rounding, ratios and calendar expressions.

Every published ratio is formed in double from exact sums and rounded once, and
percentages always as ``100.0 * n / d``. Rounding goes through a decimal, half away from
zero, so that 64.07 / 2 is 32.04 as in decimal arithmetic, whatever the binary remainder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def quotient(numerator: Column, denominator: Column) -> Column:
    """Unrounded quotient in double; NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return rounded(quotient(numerator, denominator), digits)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded percentage; NULL when the whole is zero."""
    return rounded(quotient(F.lit(100.0) * part.cast("double"), whole), digits)


def cents(amount: Column) -> Column:
    """A money column as whole cents.

    The sum of DECIMAL(12,2) is a 22-digit decimal, too wide for a machine word; whole
    cents add up exactly in a BIGINT, at half the shuffle size and without an object
    per addition.
    """
    return (amount.cast("decimal(12,2)") * 100).cast("bigint")


def money(amount_in_cents: Column) -> Column:
    """Cents as published: a double in currency units."""
    return amount_in_cents.cast("double") / 100


def money_ratio(amount_in_cents: Column, denominator: Column) -> Column:
    """Rounded amount per unit of the denominator, in currency units."""
    return rounded(quotient(money(amount_in_cents), denominator), 2)


def mean(column: Column, digits: int | None = 2) -> Column:
    """Average of the non-NULL values, from an exact sum."""
    value = quotient(F.sum(column), F.count(column))
    return value if digits is None else rounded(value, digits)


def share_true(flag: Column, digits: int = 2) -> Column:
    """Percentage of rows where the flag holds; rows with a NULL flag do not count."""
    return pct(F.count_if(flag), F.count(flag), digits)


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    chosen = None
    for condition, value in cases:
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    return F.lit(otherwise) if chosen is None else chosen.otherwise(otherwise)


def month_start(moment: Column) -> Column:
    """First day of the month as a date: cheap to group by, formatted only at the end."""
    return F.trunc(moment.cast("date"), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def months_apart(earlier: Column, later: Column) -> Column:
    """Whole calendar months between two month starts."""
    return (
        (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    ).cast("bigint")


def calendar_days(start: Column, end: Column) -> Column:
    """Difference of the date parts (23:50 to 00:10 next day is one day)."""
    return F.datediff(end.cast("date"), start.cast("date"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days, rounded down (23:50 to 00:10 next day is zero days).

    Wall-clock arithmetic throughout: a session time zone with daylight saving must not
    shorten or lengthen a day.
    """
    days = calendar_days(start, end)
    unfinished = end - F.make_dt_interval(days) < start
    return days - F.when(unfinished, 1).otherwise(0)


def clock_text(moment: Column) -> Column:
    """Wall-clock time as ``yyyy-MM-dd HH:mm:ss``, whatever the session time zone."""
    return F.substring(moment.cast("string"), 1, 19)
