"""Scalar helpers: symbols, epochs, business days, null-safe numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a valid ticker.
TICKER_PATTERN = r"^[A-Z0-9.\-]{1,15}$"


def clean_ticker(x: Column) -> Column:
    """Trimmed upper-case symbol, null when it is not a valid one."""
    t = F.upper(F.trim(x))
    return F.when(t.rlike(TICKER_PATTERN), t)


def unix_seconds(t: Column) -> Column:
    """Epoch seconds from epoch seconds or milliseconds."""
    return F.when(t > 10_000_000_000, F.floor(t / 1000)).otherwise(t).cast("bigint")


def weekday_index(d: Column) -> Column:
    """Number of weekdays from Monday 1970-01-05 up to and including the date."""
    n = F.datediff(d, F.lit(dt.date(1970, 1, 5)))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays after ``start`` up to ``end``; 0 when end is not later."""
    return F.when(start < end, weekday_index(end) - weekday_index(start)).otherwise(F.lit(0)).cast("bigint")


def latest_session(instant: Column, zone: str = "America/New_York") -> Column:
    """Newest US session day completed at a UTC instant: the day itself from 16:00 on weekdays."""
    local = F.from_utc_timestamp(instant, zone)
    day = F.to_date(local)
    weekday = F.weekday(day)
    before = F.when(weekday == 0, F.date_sub(day, 3)).when(weekday == 6, F.date_sub(day, 2)).otherwise(F.date_sub(day, 1))
    open_today = (weekday < 5) & (F.hour(local) >= 16)
    return F.when(open_today, day).otherwise(before)


def float_div(a: Column, b: Column) -> Column:
    """``a / b`` as floating point has it: over zero an infinity, or NaN of zero, where ``/`` is an error."""
    return F.when(b == 0, F.signum(a.cast("double")) * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def number(x: Column) -> Column:
    """Null-safe number from text."""
    return x.try_cast("double")


def pct(x: Column) -> Column:
    """Fraction as a percentage with one decimal."""
    return F.round(number(x) * 100, 1)
