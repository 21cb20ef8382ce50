"""The three sales tables: line items, baskets and the daily rollup.

Each is one pre-aggregated pass over the cleaned rows (the line items need a
sort per basket for their numbers).  "First" always means the first non-null
value in row order, taken as the least of (place, value) so that it survives any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.calendar import weekday_name
from tillscope.functions.numbers import total
from tillscope.names import HEADER_COLUMNS, LINE_ITEM_COLUMNS, MONEY, MONEY_COLUMNS, NUMBERED_ORDER, ROW_ORDER
from tillscope.operators.numbering import number_rows
from tillscope.session import scratch_path, storing


def _order(df: DataFrame, order: Sequence[str] | None) -> list[str]:
    order = list(ROW_ORDER if order is None else order)
    missing = [name for name in order if name not in df.columns]
    if missing:
        raise ValueError(f"row order columns {missing} not found; read with keep_order=True or pass order=")
    return order


def _placed(column: str, order: Sequence[str]) -> Column:
    """A value behind its place in row order, null where the value is."""
    places = (F.col(name).alias(f"_{i}") for i, name in enumerate(order))
    return F.when(F.col(column).isNotNull(), F.struct(*places, F.col(column).alias(column)))


def _first_parts(columns: Sequence[str], order: Sequence[str]) -> list[Column]:
    """What ``_firsts`` needs, one place for all values of a row and one more per value of patchy rows.

    Rows of equal place go by their values, from the first column on.
    """
    places = [F.col(name).alias(f"_{i}") for i, name in enumerate(order)]
    whole = reduce(and_, (F.col(name).isNotNull() for name in columns))
    together = F.when(whole, F.struct(*places, *columns)).alias("_together")
    return [together, *(F.when(~whole, _placed(name, order)).alias(f"_alone_{name}") for name in columns)]


def _firsts(columns: Sequence[str], order: Sequence[str]) -> list[Column]:
    """The first value of each column, from the minima of ``_first_parts``."""
    whole = F.col("_together")
    fields = [f"_{i}" for i in range(len(order))]
    firsts = []
    for name in columns:
        own = F.struct(*(whole[field].alias(field) for field in fields), whole[name].alias(name))
        firsts.append(F.least(F.when(whole.isNotNull(), own), F.col(f"_alone_{name}"))[name].alias(name))
    return firsts


def line_values(cleaned: DataFrame) -> DataFrame:
    """The cleaned rows with the values of line items but without their numbers, for sums over lines."""
    return _typed(cleaned)


def _typed(cleaned: DataFrame) -> DataFrame:
    """Whole quantities, and discounts that are zero where absent."""
    discounts = F.coalesce(F.col("discounts"), F.lit(0)) if "discounts" in cleaned.columns else F.lit(0)
    return cleaned.withColumns({"qty": F.col("qty").cast("bigint"), "discounts": discounts.cast(MONEY)})


def build_line_items(
    cleaned: DataFrame,
    order: Sequence[str] | None = None,
    *,
    keep_order: bool = False,
) -> DataFrame:
    """One row per exported line, numbered ``<transaction_id>-<n>`` in row order.

    ``keep_order`` keeps the order columns behind the table's own.  Baskets of any
    size are numbered the same way, slice by slice.
    """
    order = _order(cleaned, order)
    columns = [*LINE_ITEM_COLUMNS, *order]
    values = line_values(cleaned)
    needed = [name for name in dict.fromkeys(columns) if name in values.columns]
    numbered = number_rows(values.select(*needed), "transaction_id", order, "_n")
    numbered = numbered.withColumn(
        "line_item_id", F.concat(F.col("transaction_id"), F.lit("-"), F.col("_n").cast("string"))
    )
    columns = [name for name in LINE_ITEM_COLUMNS if name in numbered.columns]
    if keep_order:
        columns += [name for name in order if name not in columns]
    return numbered.select(*columns)


def build_transactions(cleaned: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per basket.

    Works on the cleaned rows: the basket headers come out of the same
    aggregation as the totals, so nothing is joined, and a basket of any size
    shrinks to one row per task before the shuffle.
    """
    order = _order(cleaned, order)
    headers = [name for name in HEADER_COLUMNS if name in cleaned.columns]
    days, sums = ["transaction_ts", "date"], ["num_line_items", "total_qty", *(f"total_{name}" for name in MONEY_COLUMNS)]
    totals = (
        F.count("*").alias("num_line_items"),
        total(F.col("qty")).alias("total_qty"),
        *(total(F.col(name)).alias(f"total_{name}") for name in MONEY_COLUMNS),
    )
    lines = _typed(cleaned).where(F.col("transaction_id").isNotNull())
    firsts = [*days, *headers]
    parts = lines.select("transaction_id", "qty", *MONEY_COLUMNS, *_first_parts(firsts, order))
    minima = (F.min(name).alias(name) for name in ("_together", *(f"_alone_{name}" for name in firsts)))
    baskets = parts.groupBy("transaction_id").agg(*totals, *minima)
    values = {name: value for name, value in zip(firsts, _firsts(firsts, order), strict=True)}
    baskets = baskets.select(
        "transaction_id", *(values[name] for name in days), *sums, *(values[name] for name in headers)
    )
    return baskets.withColumns(
        {"hour": F.hour("transaction_ts"), "weekday": weekday_name(F.col("transaction_ts"))}
    )


def build_daily_item_sales(
    lines: DataFrame, order: Sequence[str] | None = None, stored: bool | None = None
) -> DataFrame:
    """One row per day and sku; takes cleaned rows or line items with their order columns.

    One pass: sums, first values and the day's baskets come out of a grouping by day,
    sku and basket, whose rows are then grouped by day and sku.  Both shrink in each
    task before they are shuffled.

    ``stored`` rows are cheap to read, so they are read twice and the values are shuffled
    once: the lines are grouped by day and sku, and what a basket counts too often comes
    from a grouping of the three keys alone.  Unless told, rows with numbered files are
    taken as stored.
    """
    order = _order(lines, order)
    stored = tuple(order) == NUMBERED_ORDER if stored is None else stored
    sales = _typed(lines).where(F.col("date").isNotNull() & F.col("sku").isNotNull())
    firsts = ["item", "category"]
    sums = {"units_sold": "qty", **{name: name for name in MONEY_COLUMNS}}
    parts = _first_parts(firsts, order)
    names, values = ["_together", *(f"_alone_{name}" for name in firsts)], _firsts(firsts, order)
    sales = sales.select("date", "sku", "transaction_id", *dict.fromkeys(sums.values()), *parts)
    if stored:
        days = _days_of_stored(sales, names, sums)
        return days.select("date", "sku", *values, *sums, "transactions_count")
    baskets = sales.groupBy("date", "sku", "transaction_id").agg(
        *(F.min(name).alias(name) for name in names),
        *(total(F.col(name)).alias(shown) for shown, name in sums.items()),
    )
    days = baskets.groupBy("date", "sku").agg(
        *(F.min(name).alias(name) for name in names),
        *(total(F.col(shown)).alias(shown) for shown in sums),
        F.count("transaction_id").alias("transactions_count"),
    )
    return days.select("date", "sku", *values, *sums, "transactions_count")


def _days_of_stored(sales: DataFrame, names: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Minima, sums and number of baskets per day and sku.

    Every line with a basket counts one; a basket of n lines takes n - 1 back.  The baskets
    of several lines are stored first, so that their shuffle is gone before that of the values.
    """
    keys = ["date", "sku", "transaction_id"]
    again = sales.where(F.col("transaction_id").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_lines"))
    again = again.where(F.col("_lines") > 1).select("date", "sku", (1 - F.col("_lines")).alias("_baskets"))
    spark, path = sales.sparkSession, scratch_path(sales.sparkSession, "again")
    with storing(spark):
        again.write.parquet(path)
    again = spark.read.parquet(path)
    once = sales.withColumn("_baskets", F.when(F.col("transaction_id").isNotNull(), F.lit(1)).otherwise(0).cast("bigint"))
    days = (
        once.drop("transaction_id")
        .unionByName(again, allowMissingColumns=True)
        .groupBy("date", "sku")
        .agg(
            *(F.min(name).alias(name) for name in names),
            *(total(F.col(name)).alias(shown) for shown, name in sums.items()),
            total(F.col("_baskets")).alias("transactions_count"),
        )
    )
    types = {field.name: field.dataType for field in days.schema.fields}
    # The types that sums of sums have.
    wide = {
        shown: F.col(shown).cast(T.DecimalType(min(38, types[shown].precision + 10), types[shown].scale))
        for shown in sums
        if isinstance(types[shown], T.DecimalType)
    }
    return days.withColumns(wide) if wide else days


def build_tables(
    cleaned: DataFrame, order: Sequence[str] | None = None, stored: bool | None = None
) -> dict[str, DataFrame]:
    """All three tables from cleaned, valid rows; ``stored`` as for the daily rollup."""
    return {
        "transactions": build_transactions(cleaned, order),
        "line_items": build_line_items(cleaned, order),
        "daily_item_sales": build_daily_item_sales(cleaned, order, stored),
    }
