"""Date-filtered reports over line items and baskets.

Every report starts from a range filter that reaches the Parquet scan and a
pre-aggregated grouping; what follows works on the few grouped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.calendar import DateLike, between_dates, month_start, weekday_index
from tillscope.functions.numbers import percent, show_count, show_money, total
from tillscope.names import KPIS, WEEKDAYS


def date_bounds(lines: DataFrame) -> DataFrame:
    """One row: first and last day with sales, today for both when there are none."""
    return lines.agg(
        F.coalesce(F.min("date"), F.current_date()).alias("min_date"),
        F.coalesce(F.max("date"), F.current_date()).alias("max_date"),
    )


def _kpi_sums() -> list[Column]:
    return [
        total(F.col("net_sales")).alias("net_sales"),
        F.count_distinct("transaction_id").alias("transactions"),
        total(F.col("qty")).alias("units"),
        F.count_distinct("item").alias("distinct_items"),
    ]


def _average_basket() -> Column:
    return F.when(F.col("transactions") == 0, 0.0).otherwise(
        F.col("net_sales").cast("double") / F.col("transactions")
    )


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the given order; each task keeps no more than ``n``."""
    return df.orderBy(*order).limit(n)


def headline_kpis(lines: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """One row of net sales, baskets, average basket, units and distinct item names; zeros when empty."""
    sums = between_dates(lines, start, end).agg(*_kpi_sums())
    return sums.select("net_sales", "transactions", _average_basket().alias("avg_basket"), "units", "distinct_items")


def headline_kpis_by_range(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The KPI row of each of a few (label, start, end) ranges, in one pass over the lines.

    The ranges may overlap; a range without sales has no row.
    """
    return in_ranges(lines, ranges).groupBy("label").agg(*_kpi_sums()).withColumn("avg_basket", _average_basket())


def in_ranges(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row once per (label, start, end) range that its date lies in, with the label."""
    few = ranges.agg(F.collect_list(F.struct("label", "start", "end"))).scalar()
    own = F.filter("_ranges", lambda r: F.col("date").between(r["start"], r["end"]))
    return (
        df.withColumn("_ranges", few)
        .select("*", F.inline(own))
        .drop("_ranges", "start", "end")
    )


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """The KPI row as display text."""
    return kpis.select(
        *(
            (show_money if is_money else show_count)(F.col(column)).alias(column)
            for _, column, is_money in KPIS
        )
    )


def category_mix(lines: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Net sales and share of the total per category, largest first."""
    sums = between_dates(lines, start, end).groupBy("category").agg(F.sum("net_sales").alias("net_sales"))
    # The total reuses the grouped shuffle; nothing gathers all categories in one task.
    whole = sums.agg(F.sum("net_sales")).scalar()
    return sums.withColumn("pct_of_total", percent(F.col("net_sales"), whole)).orderBy(
        F.desc_nulls_last("net_sales"), F.asc_nulls_last("category")
    )


def category_mix_ascending(lines: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """The mix in the order a horizontal bar chart draws it."""
    return category_mix(lines, start, end).orderBy("net_sales", F.desc_nulls_last("category"))


def hour_weekday_counts(baskets: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Baskets per weekday and hour: always 168 rows, Monday 0 h to Sunday 23 h."""
    slot = F.col("id").cast("int")
    names = F.array(*map(F.lit, WEEKDAYS))
    week = baskets.sparkSession.range(0, 7 * 24, 1, 1).select(
        slot.alias("_slot"),
        F.get(names, (slot / 24).cast("int")).alias("weekday"),
        (slot % 24).alias("hour"),
    )
    counts = (
        between_dates(baskets, start, end)
        .where(F.col("weekday").isin(*WEEKDAYS) & F.col("hour").between(0, 23))
        .groupBy("weekday", "hour")
        .agg(F.count("*").alias("transactions"))
    )
    # Seven names and 24 hours: the counts have 168 rows at most.
    return (
        week.join(F.broadcast(counts), ["weekday", "hour"], "left")
        .orderBy("_slot")
        .select("weekday", "hour", F.coalesce("transactions", F.lit(0)).cast("bigint").alias("transactions"))
    )


def hour_weekday_matrix(grid: DataFrame) -> DataFrame:
    """The grid as a matrix: one row per weekday, one column per hour."""
    hours = list(range(24))
    return (
        grid.groupBy("weekday")
        .pivot("hour", hours)
        .agg(F.first("transactions"))
        .na.fill(0)
        .select("weekday", *(F.col(str(h)).alias(f"h{h:02d}") for h in hours))
        .orderBy(weekday_index(F.col("weekday")))
    )


def month_over_month(lines: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Net sales per month, and the change against the previous month that has sales."""
    monthly = (
        between_dates(lines, start, end)
        .groupBy(month_start(F.col("date")).alias("month"))
        .agg(F.sum("net_sales").alias("net_sales"))
    )
    # One row per calendar month: the window is small however much was sold.
    before = F.lag("net_sales").over(Window.orderBy("month"))
    change = percent(F.col("net_sales") - before, before)
    return monthly.select("month", "net_sales", change.alias("mom_pct_change")).orderBy("month")


def _top(lines: DataFrame, by: Column, name: str, n: int) -> DataFrame:
    return (
        lines.groupBy("item")
        .agg(F.sum(by).alias(name))
        .orderBy(F.desc_nulls_last(name), F.asc_nulls_last("item"))
        .limit(n)
    )


def top_items_by_units(lines: DataFrame, start: DateLike, end: DateLike, n: int = 20) -> DataFrame:
    return _top(between_dates(lines, start, end), F.col("qty"), "units", n)


def top_items_by_sales(lines: DataFrame, start: DateLike, end: DateLike, n: int = 20) -> DataFrame:
    return _top(between_dates(lines, start, end), F.col("net_sales"), "net_sales", n)


def units_by_category(daily: DataFrame) -> DataFrame:
    """Units per category, from the daily rollup."""
    return daily.groupBy("category").agg(F.sum("units_sold").alias("units"))


def top_skus_by_units(daily: DataFrame, n: int = 5) -> DataFrame:
    """The best selling skus, from the daily rollup."""
    return (
        daily.groupBy("sku", "item")
        .agg(F.sum("units_sold").alias("units_sold"))
        .orderBy(F.desc_nulls_last("units_sold"), F.asc_nulls_last("sku"), F.asc_nulls_last("item"))
        .limit(n)
    )
