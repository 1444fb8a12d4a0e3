"""Calendar arithmetic on epoch seconds, without any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK = 86400, 7 * 86400
#: 1970-01-05, the first Monday.
MONDAY = 4 * DAY


def _date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / DAY).cast("int"))


def day(seconds: Column) -> Column:
    """Start of the day."""
    return (F.floor(seconds / DAY) * DAY).cast("long")


def week(seconds: Column) -> Column:
    """Start of the week, which begins on Monday."""
    return (F.floor((seconds - MONDAY) / WEEK) * WEEK + MONDAY).cast("long")


def month(seconds: Column) -> Column:
    """Start of the first day of the month."""
    return (F.unix_date(F.trunc(_date(seconds), "MM")) * DAY).cast("long")


def hour_bin(seconds: Column, hours: int = 4) -> Column:
    """First hour of the bin of `hours` hours."""
    hour = F.floor(F.pmod(seconds, F.lit(DAY)) / 3600)
    return (F.floor(hour / hours) * hours).cast("int")


def day_kind(seconds: Column) -> Column:
    """weekend for Saturday and Sunday, else weekday."""
    return F.when(F.dayofweek(_date(seconds)).isin(1, 7), "weekend").otherwise("weekday")


def days_in_month(seconds: Column) -> Column:
    return F.dayofmonth(F.last_day(_date(seconds)))


def daily_overlap(start: Column, end: Column, hours: int) -> Column:
    """Seconds of [start, end) within the first `hours` hours of any day."""
    width = hours * 3600

    def until(t: Column) -> Column:
        return F.floor(t / DAY) * width + F.least(F.pmod(t, F.lit(DAY)), F.lit(width))

    return (until(end) - until(start)).cast("long")
