"""Day and time expressions. The day a report is for is always a parameter, never the wall clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indonesian short names, Sunday first and January first.
WEEKDAYS = ["Min", "Sen", "Sel", "Rab", "Kam", "Jum", "Sab"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]

# Names of the date presets.
PRESETS = ["today", "thisWeek", "thisMonth", "lastMonth", "allTime"]


def as_day(value: str | date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def day_label(day: Column) -> Column:
    """Sel, 07 Mei"""
    weekday = F.element_at(F.array(*[F.lit(n) for n in WEEKDAYS]), F.dayofweek(day))
    month = F.element_at(F.array(*[F.lit(n) for n in MONTHS]), F.month(day))
    return F.concat(weekday, F.lit(", "), F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), F.lit(" "), month)


def utc_day(stamp: Column) -> Column:
    """Day of a UTC wall-clock timestamp."""
    return stamp.cast("timestamp_ntz").cast("date")


def local_datetime(stamp: Column, zone: str = "UTC") -> Column:
    """YYYY-MM-DD HH:MM:SS in a zone, from a UTC wall-clock timestamp."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp.cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def date_preset(name: str, as_of: str | date | Column) -> tuple[Column, Column]:
    """Inclusive first and last day of a preset; NULL bounds mean no limit."""
    day = as_day(as_of)
    if name == "today":
        return day, day
    if name == "thisWeek":
        monday = F.trunc(day, "WEEK")
        return monday, F.date_add(monday, 6)
    if name == "thisMonth":
        return F.trunc(day, "MM"), F.last_day(day)
    if name == "lastMonth":
        first = F.add_months(F.trunc(day, "MM"), -1)
        return first, F.last_day(first)
    if name == "allTime":
        return F.lit(None).cast("date"), F.lit(None).cast("date")
    raise ValueError(f"unknown preset {name!r}; one of {PRESETS}")
