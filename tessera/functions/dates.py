"""Dates of crawl ranges in their three spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US, COMPACT = "M/d/yyyy", "yyyyMMdd"


def valid_date(c: Column) -> Column:
    """Return the date of an ISO string; an invalid one is an error."""
    day = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(c.isNull() | day.isNotNull(), day).otherwise(
        F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")
    )


def days(start: Column, end: Column) -> Column:
    """Return all days from ``start`` to ``end``, both included; none if they are reversed."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def us_date(day: Column) -> Column:
    """Write a date as month, day and year without zeros in front."""
    return F.date_format(day, US)


def from_us_date(c: Column) -> Column:
    """Read such a date; null if it is none."""
    return F.try_to_date(c, US)


def compact(day: Column) -> Column:
    """Write a date as eight digits."""
    return F.date_format(day, COMPACT)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """Return the first and last second of a day as ISO strings."""
    text = F.date_format(day, "yyyy-MM-dd")
    return F.concat(text, F.lit("T00:00:00Z")), F.concat(text, F.lit("T23:59:59Z"))


def age_window(start: Column, end: Column, today: Column) -> Column:
    """Write a date range as ages in days; an error unless both dates are before ``today``."""
    label = F.concat(F.datediff(today, end), F.lit("-"), F.datediff(today, start), F.lit("+days"))
    late = (start >= today) | (end >= today)
    return F.when(late, F.raise_error(F.lit("dates must be earlier than today")).cast("string")).otherwise(label)
