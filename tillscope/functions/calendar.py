"""Calendar expressions and the date-range filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.names import FIRST_DAYS_OF_MONTH, SUMMER_MONTHS, WEEKDAYS, WEEKEND

# Column that stored tables are laid out by.
MONTH = "sale_month"

DateLike = dt.date | dt.datetime | str | Column


def as_date(value: DateLike) -> Column:
    """A date literal from a date, a timestamp or ISO text; columns pass through."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(value)


def in_range(start: DateLike, end: DateLike, date: str = "date") -> Column:
    """Both days included, written half-open so that a time of day on the last day counts too."""
    return (F.col(date) >= as_date(start)) & (F.col(date) < F.date_add(as_date(end), 1))


def between_dates(df: DataFrame, start: DateLike, end: DateLike, date: str = "date") -> DataFrame:
    """The rows of a date range; tables laid out by month read only the months it touches."""
    if date == "date" and MONTH in df.columns:
        df = df.where(F.col(MONTH).between(month_start(as_date(start)), month_start(as_date(end))))
    return df.where(in_range(start, end, date))


def weekday_name(date: Column) -> Column:
    """English day name, whatever the session locale or time zone."""
    return F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(F.to_date(date)))


def weekday_index(name: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return (F.array_position(F.array(*map(F.lit, WEEKDAYS)), name) - 1).cast("int")


def month_start(date: Column) -> Column:
    return F.trunc(F.to_date(date), "MM")


def is_weekend(date: Column) -> Column:
    return weekday_name(date).isin(*WEEKEND)


def is_month_opening(date: Column) -> Column:
    return F.dayofmonth(date).isin(*FIRST_DAYS_OF_MONTH)


def is_summer(date: Column) -> Column:
    return F.month(date).isin(*SUMMER_MONTHS)
