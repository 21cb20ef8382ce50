"""Sales against stockout windows ``(sku, start_date, end_date)``, both days included.

Windows are cut into bins of seven days and joined by sku and bin, with the range as a
further condition: a sale meets only the windows of its own week, not all those of its
sku, and the partition of a hot sku and week can still be split.  Equal windows count
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = ("sku", "start_date", "end_date")


def window_days(windows: DataFrame) -> DataFrame:
    """One row per window and day; a window that ends before it starts has one row without a day."""
    days = F.when(
        F.col("start_date") <= F.col("end_date"),
        F.sequence("start_date", "end_date", F.expr("interval 1 day")),
    )
    return windows.select(*WINDOW, F.explode_outer(days).alias("date"))


BIN_DAYS = 7


def _bin(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BIN_DAYS)


def binned(windows: DataFrame) -> DataFrame:
    """One row per different window and bin it touches; a window without a day has one row without a bin."""
    bins = F.when(
        F.col("start_date") <= F.col("end_date"), F.sequence(_bin(F.col("start_date")), _bin(F.col("end_date")))
    )
    return windows.select(*WINDOW).distinct().select(*WINDOW, F.explode_outer(bins).alias("_bin"))


def _inside(sales: DataFrame, windows: DataFrame) -> Column:
    """Whether a sale lies in a binned window; each pair meets in one bin only."""
    return (
        (sales["sku"] == windows["sku"])
        & (_bin(sales["date"]) == windows["_bin"])
        & sales["date"].between(windows["start_date"], windows["end_date"])
    )


def sale_days_in_windows(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of the daily rollup inside each different window; windows without any stay, with 0."""
    windows = binned(windows)
    sold = daily.select("sku", "date")
    return (
        windows.join(sold, _inside(sold, windows), "left")
        .groupBy(*(windows[name] for name in WINDOW))
        .agg(
            F.when(F.col("start_date") > F.col("end_date"), 0)
            .otherwise(F.datediff("end_date", "start_date") + 1)
            .cast("bigint")
            .alias("window_days"),
            F.count("date").alias("sale_days"),
        )
    )


def sales_inside_windows(sales: DataFrame, windows: DataFrame) -> DataFrame:
    """The sales that a stockout should have made impossible."""
    windows = binned(windows)
    return sales.join(windows, _inside(sales, windows), "left_semi")


def sales_outside_windows(sales: DataFrame, windows: DataFrame) -> DataFrame:
    windows = binned(windows)
    return sales.join(windows, _inside(sales, windows), "left_anti")


def merged_windows(windows: DataFrame) -> DataFrame:
    """Windows that overlap or meet become one per sku; those without a day go."""
    by_start = Window.partitionBy("sku").orderBy("start_date", "end_date")
    before = F.max("end_date").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start_date") > F.date_add(before, 1)), 1).otherwise(0)
    return (
        windows.select(*WINDOW)
        .where(F.col("start_date") <= F.col("end_date"))
        .distinct()
        .withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("sku", "_island")
        .agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
        .select(*WINDOW)
    )


def flag_out_of_stock(rows: DataFrame, windows: DataFrame, name: str = "out_of_stock") -> DataFrame:
    """Add whether the row's day lies in a window of its sku; a sku without window is in stock.

    Merged windows of a sku have no day in common, so no row is met twice.
    """
    # Dealt anew, so that the join has a shuffle of its own whose hot skus can be split.
    merged = binned(merged_windows(windows)).repartition("start_date")
    joined = rows.join(merged, _inside(rows, merged), "left")
    return joined.select(*(rows[column] for column in rows.columns), merged["start_date"].isNotNull().alias(name))
