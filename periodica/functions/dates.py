"""Calendar column functions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DAY_MS = 86_400_000
# Fixed value: the text of a duration.
DURATION = "%d years, %d months, %d days"


def epoch_ms_to_date(millis: Column) -> Column:
    """UTC calendar date of an epoch-millisecond number; missing counts as 0.

    NULL for a number beyond any calendar date.
    """
    ms = F.coalesce(millis, F.lit(0)).try_cast("bigint")
    days = ((ms - F.pmod(ms, F.lit(_DAY_MS))) / F.lit(_DAY_MS)).try_cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def inclusive_duration(first: Column, last: Column) -> Column:
    """Calendar difference as text, counting both the first and the last day."""
    day_gap = F.dayofmonth(last) - F.dayofmonth(first)
    borrow = day_gap < 0
    previous_month_days = F.dayofmonth(F.date_sub(last, F.dayofmonth(last)))
    days = F.when(borrow, day_gap + previous_month_days).otherwise(day_gap) + 1
    month_gap = F.month(last) - F.month(first) - borrow.cast("int")
    years = F.year(last) - F.year(first) - (month_gap < 0).cast("int")
    months = F.when(month_gap < 0, month_gap + 12).otherwise(month_gap)
    return F.format_string(DURATION, years, months, days)


def isoweek_code(date: Column) -> Column:
    """ISO year and week as one number, e.g. 200453; jumps at each new year."""
    return F.extract(F.lit("YEAROFWEEK"), date) * 100 + F.weekofyear(date)


def week_ordinal(date: Column) -> Column:
    """Weeks (from Monday) since 1970-01-05; consecutive weeks differ by one."""
    days = F.datediff(date, F.lit("1970-01-05").cast("date"))
    return ((days - F.pmod(days, F.lit(7))) / F.lit(7)).cast("int")


def month_ordinal(date: Column) -> Column:
    """Months since year 0; December and January differ by one."""
    return F.year(date) * 12 + F.month(date)
