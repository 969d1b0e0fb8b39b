"""Time buckets, calendar labels and request-range rules."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquarry.functions.text import ColumnLike, as_column

# The bucket sizes a caller may ask for.
TIME_UNITS = ("hour", "day", "week", "month", "quarter", "year")

# Longest hourly range and longest range of any kind, in days.
MAX_HOURLY_DAYS = 20
MAX_RANGE_DAYS = 45


def check_unit(unit: str) -> str:
    lowered = unit.lower()
    if lowered not in TIME_UNITS:
        raise ValueError(f"unknown time unit {unit!r}; expected one of {', '.join(TIME_UNITS)}")
    return lowered


def local_bucket(ts: ColumnLike, unit: str, tz: str) -> Column:
    """Start of the hour/day/week/... that holds ``ts``, on the wall clock of ``tz``.

    An hour that clocks repeat when they go back is one bucket of two hours, as it has one name.
    """
    return F.date_trunc(check_unit(unit), F.from_utc_timestamp(as_column(ts), tz))


def weekday_name(day: ColumnLike) -> Column:
    return F.upper(F.date_format(as_column(day), "EEEE"))


def week_of_year(day: ColumnLike) -> Column:
    """C's ``%W``: weeks start on Monday, days before the first Monday are week 0."""
    d = as_column(day)
    return F.floor((F.dayofyear(d) + F.lit(6) - F.weekday(d)) / F.lit(7)).cast("int")


def day_shifted(day: ColumnLike, days: int, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.date_add(as_column(day), days), pattern)


def as_date(value: str | date) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.strptime(value, "%Y-%m-%d").date()


def within_local_days(
    ts: ColumnLike,
    start: str | date | None,
    end: str | date | None,
    tz: str,
    end_inclusive: bool = False,
) -> Column:
    """True for instants from the first moment of ``start`` to the end of day ``end`` in ``tz``.

    The bounds are turned to UTC, so the test is a plain range on the stored column and reaches the
    scan.  A bound of ``None`` is open.  ``end_inclusive`` also lets the first instant of the
    following day in.
    """
    column = as_column(ts)
    inside = column.isNotNull()
    if start is not None:
        low = F.to_utc_timestamp(F.lit(f"{as_date(start)} 00:00:00").cast("timestamp"), tz)
        inside = inside & (column >= low)
    if end is not None:
        after = as_date(end) + timedelta(days=1)
        high = F.to_utc_timestamp(F.lit(f"{after} 00:00:00").cast("timestamp"), tz)
        inside = inside & (column <= high if end_inclusive else column < high)
    return inside


@dataclass(frozen=True)
class ReportRange:
    start: date
    end: date
    unit: str
    cut_days: int = 0


def clamp_range(
    start: str | date,
    end: str | date,
    unit: str,
    max_hourly_days: int | None = None,
    max_days: int | None = None,
) -> ReportRange:
    """Long hourly ranges become daily; very long ranges keep only their last ``max_days`` days.

    Without limits the range stays as asked for.  ``cut_days`` of the result counts the days left out.
    """
    first, last = as_date(start), as_date(end)
    span = (last - first).days
    bucket = check_unit(unit)
    if max_hourly_days is not None and bucket == "hour" and span > max_hourly_days:
        bucket = "day"
    cut = max(0, span - max_days) if max_days is not None else 0
    return ReportRange(first + timedelta(days=cut), last, bucket, cut)
