"""Guarded arithmetic, cents and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; null where the whole is zero or null."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def total(value: Column) -> Column:
    """A sum that is zero, not null, where there is nothing to add."""
    return F.coalesce(F.sum(value), F.lit(0))


def mean(value: Column, where: Column | None = None) -> Column:
    """The mean of the rows that satisfy ``where``, from exact sums."""
    if where is not None:
        value = F.when(where, value)
    return ratio(F.sum(value), F.count(value))


def to_cents(value: Column) -> Column:
    """Half-up to two decimals."""
    return F.round(value, 2)


def cents_from_text(text: Column) -> Column:
    """Whole cents of ``-$1,234.50``, keeping sign and ignoring marks; strict, bad text raises."""
    text = F.trim(text)
    bare = F.regexp_replace(text, "[-$,]", "")
    cents = (bare.cast("decimal(28,6)") * 100).cast("bigint")
    return F.when(text.startswith("-"), -cents).otherwise(cents)


def show_money(value: Column) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(value, 2))


def show_count(value: Column) -> Column:
    """``1,234``"""
    return F.format_number(value, 0)
