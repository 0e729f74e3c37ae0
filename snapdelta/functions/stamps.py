"""Version stamps and display dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two date formats are yyyyMMddHHmmss and yyyy-MM-dd HH:mm:ss, whole seconds both.

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def version_stamp(ts: Column) -> Column:
    """Version name of a point in time in UTC, whatever the session's zone; fractions of a second are cut off."""
    return _in_utc(ts, "yyyyMMdd", "", "")


def display_date(ts: Column) -> Column:
    """A stored date as shown to people, in UTC."""
    return _in_utc(ts, "yyyy-MM-dd", " ", ":")


def _in_utc(ts: Column, day_format: str, after_day: str, between: str) -> Column:
    """Day and time counted from the epoch: formatting a timestamp would use the session's zone."""
    micros_of = F.unix_micros(ts.cast("timestamp"))
    second = (micros_of - F.pmod(micros_of, F.lit(1_000_000))) / F.lit(1_000_000)
    in_day = F.pmod(second.cast("long"), F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((second - in_day) / 86_400).cast("int"))
    hour, minute = F.floor(in_day / 3600), F.floor(F.pmod(in_day, F.lit(3600)) / 60)
    parts = [F.lpad(x.cast("string"), 2, "0") for x in (hour, minute, F.pmod(in_day, F.lit(60)))]
    return F.concat(F.date_format(day, day_format), F.lit(after_day), F.concat_ws(between, *parts))


def stamp_of(moment: dt.datetime) -> str:
    """``version_stamp`` of a driver-side datetime."""
    return _utc(moment).strftime("%Y%m%d%H%M%S")


def stamp_of_micros(moment: int) -> str:
    """``version_stamp`` of microseconds since the epoch."""
    return stamp_of(EPOCH + dt.timedelta(microseconds=moment))


def timestamp_literal(moment: dt.datetime) -> Column:
    """A UTC moment as a TIMESTAMP literal, whatever the session or machine time zone."""
    return F.timestamp_micros(F.lit(micros(moment)))


def micros(moment: dt.datetime) -> int:
    """Microseconds since the epoch."""
    return (_utc(moment) - EPOCH) // dt.timedelta(microseconds=1)


def _utc(moment: dt.datetime) -> dt.datetime:
    """Naive datetimes are taken as UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=dt.timezone.utc)
    return moment.astimezone(dt.timezone.utc)
