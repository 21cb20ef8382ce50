"""Lenient text parsing: a cell that does not parse becomes null, never an error.

All of it is built-in column expressions.  Timestamps are zone-free
(``timestamp_ntz``), so the session time zone cannot move or drop an hour, and
every cast is a ``try_cast`` because plain casts raise under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.names import MONEY, MONEY_PATTERN

# Every character that counts as white space in Unicode text, not only the blank.
_WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_DATE = r"^(0?[1-9]|1[0-2])/(3[01]|[12]\d|0[1-9]| ?[1-9])/(?!0000)\d{4}$"
# Seconds 60 and 61 are leap seconds and run on into the next minute.
_CLOCK = r"^(0?[1-9]|1[0-2]):[0-5]?\d:([0-5]?\d|6[01])\s+[AaPp][Mm]$"
# The first and last microsecond of 64-bit nanoseconds.
LIMITS = ("1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The usual shapes, without white space around them.  Cells of these are parsed as they
# stand; only the others are stripped and taken apart step by step.
_USUAL_DATE = r"^(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])/(?!0000)\d{4}\z"
_USUAL_MONEY = MONEY_PATTERN.removesuffix("$") + r"\z"
_USUAL_NUMBER = r"^\d{1,18}(\.\d{1,18})?\z"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def parse_day(text: Column) -> Column:
    """``01/15/2025`` or ``1/5/2025`` as a date; impossible days are null."""
    bare = strip(text)
    iso = F.regexp_replace(bare, r"^(\d+)/ ?(\d+)/(\d+)$", "$3-$1-$2")
    usual = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 1, 2), F.lit("-"), F.substring(text, 4, 2))
    return F.when(text.rlike(_USUAL_DATE), usual).when(bare.rlike(_DATE), iso).try_cast("date")


def parse_clock(text: Column) -> Column:
    """``02:30:00 PM`` as the interval since midnight."""
    text = strip(text)
    clock = F.when(text.rlike(_CLOCK), text)
    # The hour after noon or midnight is written 12 but counts as 0.
    hour = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int") % 12
    minute = F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int")
    # One digit or two; the cast passes over white space.
    second = F.left(F.split_part(clock, F.lit(":"), F.lit(3)), F.lit(2)).try_cast("int")
    afternoon = F.when(F.lower(F.right(text, F.lit(2))) == "pm", 12).otherwise(0)
    return F.make_dt_interval(hours=hour + afternoon, mins=minute, secs=second.cast("decimal(18,6)"))


def _within_limits(moment: Column) -> Column:
    """Null outside the span that the contract's nanosecond timestamps know."""
    first, last = (F.lit(text).cast("timestamp_ntz") for text in LIMITS)
    return F.when(moment.between(first, last), moment)


def parse_timestamp(date: Column, time: Column) -> Column:
    """``01/15/2025`` and ``02:30:00 PM`` -> 2025-01-15 14:30:00."""
    return _within_limits(parse_day(date).cast("timestamp_ntz") + parse_clock(time))


def parse_date(date: Column) -> Column:
    """Midnight of ``01/15/2025``, for exports without a time column."""
    return _within_limits(parse_day(date).cast("timestamp_ntz"))


def parse_money(text: Column) -> Column:
    """``$12.34`` -> 12.34 and ``-$1.23`` -> -1.23; no other shape is repaired."""
    bare = strip(text)
    amount = F.when(text.rlike(_USUAL_MONEY), text).when(bare.rlike(MONEY_PATTERN), bare)
    return F.replace(amount, F.lit("$"), F.lit("")).try_cast(MONEY)


def parse_number(text: Column) -> Column:
    """A finite decimal number as double; Spark alone would also take ``3d`` and ``inf``."""
    bare = strip(text)
    value = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    # The usual shape is too short to be infinite.
    return F.when(text.rlike(_USUAL_NUMBER), text.try_cast("double")).when(F.abs(value) < float("inf"), value)
