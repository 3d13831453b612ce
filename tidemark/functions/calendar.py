"""Calendar expressions: period starts, date parts and their labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import name

# Labels used by every month / weekday report.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

PERIODS = ("hour", "day", "week", "iso_week", "month", "month_end", "quarter", "year")


def period_start(time: Column, freq: str) -> Column:
    """The bucket a timestamp belongs to; a date for every period of a day or longer.

    ``week`` starts on Sunday, ``iso_week`` on Monday, ``month_end`` is labelled by its last day.
    """
    if freq == "hour":
        return F.date_trunc("hour", time)
    day = F.to_date(time)
    if freq == "day":
        return day
    if freq == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if freq == "iso_week":
        return F.trunc(day, "week")
    if freq == "month_end":
        return F.last_day(day)
    if freq in ("month", "quarter", "year"):
        return F.trunc(day, freq)
    raise ValueError(f"unknown period {freq!r}; use one of {PERIODS}")


def weekday_monday0(time: Column) -> Column:
    return F.weekday(time)


def weekday_sunday0(time: Column) -> Column:
    return F.dayofweek(time) - 1


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), month.cast("int"))


def day_label(monday0: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_LABELS]), monday0.cast("int") + 1)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    """The 14 calendar columns of the analysis dialect (Monday = 0, ISO weeks)."""
    day = F.to_date(name(time))
    month = F.month(day)
    last = F.last_day(day)
    return df.withColumns(
        {
            "year": F.year(day),
            "month": month,
            "day_of_month": F.dayofmonth(day),
            "day_of_week": F.weekday(day),
            "day_of_year": F.dayofyear(day),
            "week_of_year": F.weekofyear(day),
            "quarter": F.quarter(day),
            "is_weekend": _flag(F.weekday(day) >= 5),
            "is_month_start": _flag(F.dayofmonth(day) == 1),
            "is_month_end": _flag(day == last),
            "is_quarter_start": _flag(day == F.trunc(day, "quarter")),
            "is_quarter_end": _flag((day == last) & (month % 3 == 0)),
            "is_year_start": _flag(F.dayofyear(day) == 1),
            "is_year_end": _flag((month == 12) & (F.dayofmonth(day) == 31)),
        }
    )


def calendar_features_sunday(df: DataFrame, time: str) -> DataFrame:
    """The dashboard dialect: Sunday = 0 and weeks counted from the Sunday before 1 January.

    A value that is not a date gives nulls. The week number keeps the time of day, as the dashboard
    formula does, so a Saturday afternoon already counts to the following week.
    """
    stamp = name(time).cast("timestamp_ntz")
    day = F.to_date(stamp)
    new_year = F.trunc(day, "year")
    seconds = F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)
    elapsed = F.datediff(day, new_year) + seconds / F.lit(86400.0)
    last = F.last_day(day)
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "day_of_month": F.dayofmonth(day),
            "day_of_week": F.dayofweek(day) - 1,
            "day_of_year": F.dayofyear(day),
            "week_of_year": F.ceil((elapsed + F.dayofweek(new_year)) / F.lit(7.0)).cast("int"),
            "quarter": F.quarter(day),
            "is_weekend": _flag(F.dayofweek(day).isin(1, 7)),
            "is_month_start": _flag(F.dayofmonth(day) == 1),
            "is_month_end": _flag(day == last),
        }
    )


def season(time: Column) -> Column:
    """Winter = 1 (December to February) .. autumn = 4."""
    return (F.floor((F.month(time) % 12) / 3) + 1).cast("int")


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a repeating quantity."""
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def parse_time(value: Column, *formats: str) -> Column:
    """First format that fits; null where none does. Without formats, Spark's ISO parsing."""
    if not formats:
        return F.try_to_timestamp(value)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(fmt)) for fmt in formats])


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))
