"""Zone-less time: literals, half-open windows and calendar parts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def moment(value: str | datetime) -> Column:
    """A ``timestamp_ntz`` literal."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def in_window(time: Column, start: Column, end: Column) -> Column:
    """TRUE where ``start <= time < end``; FALSE, never NULL, for a missing time."""
    return time.isNotNull() & (time >= start) & (time < end)


def within(time: Column, origin: Column, length: timedelta) -> Column:
    """TRUE where ``time`` falls in the half-open interval of ``length`` that opens at ``origin``."""
    return (time >= origin) & (time < origin + F.lit(length))


def hour(time: Column) -> Column:
    return F.hour(time)


def iso_weekday(time: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return (F.weekday(time) + 1).cast("int")


def weekday_name(time: Column) -> Column:
    """The English name, whatever the locale and time zone of the session."""
    return F.get(F.lit(list(WEEKDAYS)), F.weekday(time))


def is_weekend(time: Column) -> Column:
    return iso_weekday(time).isin(6, 7)
