"""Sanity figures of a dataset: totals, shares and seasonal lifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.calendar import is_month_opening, is_summer, is_weekend
from tillscope.functions.numbers import mean, percent, total


def dataset_summary(lines: DataFrame, baskets: DataFrame) -> DataFrame:
    """One row: date range, baskets, units, net sales, mean basket size and value."""
    per_basket = baskets.agg(
        F.struct(
            F.count("*").alias("transactions"),
            mean(F.col("num_line_items")).alias("avg_items_per_basket"),
            mean(F.col("total_net_sales")).alias("avg_basket_value"),
        )
    ).scalar()
    sums = lines.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        total(F.col("qty")).alias("units"),
        total(F.col("net_sales")).alias("net_sales"),
    )
    return sums.withColumn("_b", per_basket).select(
        "min_date",
        "max_date",
        "_b.transactions",
        "units",
        "net_sales",
        "_b.avg_items_per_basket",
        "_b.avg_basket_value",
    )


def category_share(lines: DataFrame) -> DataFrame:
    """Percent of net sales per category, to one decimal, largest first."""
    sums = lines.groupBy("category").agg(F.sum("net_sales").alias("_sales"))
    whole = sums.agg(F.sum("_sales")).scalar()
    return (
        sums.where(F.col("category").isNotNull())
        .withColumn("pct", F.round(percent(F.col("_sales"), whole), 1))
        .orderBy(F.desc("_sales"), "category")
        .select("category", "pct")
    )


def daily_totals(lines: DataFrame) -> DataFrame:
    """Net sales per day."""
    return lines.where(F.col("date").isNotNull()).groupBy("date").agg(total(F.col("net_sales")).alias("net_sales"))


def weekend_lift(lines: DataFrame) -> DataFrame:
    """Mean net sales of a day from Friday to Sunday, and of the other days."""
    weekend = is_weekend(F.col("date"))
    return daily_totals(lines).agg(
        mean(F.col("net_sales"), weekend).alias("weekend_avg"),
        mean(F.col("net_sales"), ~weekend).alias("weekday_avg"),
    )


def month_opening_lift(lines: DataFrame) -> DataFrame:
    """Mean net sales of the first three days of a month, and of the other days."""
    opening = is_month_opening(F.col("date"))
    return daily_totals(lines).agg(
        mean(F.col("net_sales"), opening).alias("opening_avg"),
        mean(F.col("net_sales"), ~opening).alias("other_avg"),
    )


def category_summer_lift(lines: DataFrame, category: str = "Beverages") -> DataFrame:
    """Mean daily net sales of one category in June to August, and in the other months."""
    summer = is_summer(F.col("date"))
    return daily_totals(lines.where(F.col("category") == category)).agg(
        mean(F.col("net_sales"), summer).alias("summer_avg"),
        mean(F.col("net_sales"), ~summer).alias("other_avg"),
    )


def row_count_check(
    df: DataFrame, expected: int | DataFrame, tolerance: float = 0.10, where: Column | None = None
) -> DataFrame:
    """One row: the row count and whether it lies within ``tolerance`` of the expected one.

    The expected count is a number, or that of the rows of another table.  Only rows
    that meet ``where`` count, if it is given; they are counted, not filtered, so that
    what ``where`` looks at is worked out once.
    """
    wanted = expected.agg(F.count("*")).scalar() if isinstance(expected, DataFrame) else F.lit(expected)
    rows = F.count("*") if where is None else F.count(F.when(where, 1))
    counted = df.agg(rows.alias("row_count")).withColumn("_wanted", wanted)
    near = F.col("row_count").between(F.col("_wanted") * (1 - tolerance), F.col("_wanted") * (1 + tolerance))
    return counted.select("row_count", near.alias("in_tolerance"))
