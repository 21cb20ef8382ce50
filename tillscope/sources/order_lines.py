"""Sales lines over the order tables ``lineitem``, ``orders`` and ``part``.

An order is a basket, a part is a sku, its name the item and its type the
category.  Order dates carry no time of day, so one is derived from the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.names import MONEY, RAW_COLUMNS

# Columns that fix the order of the lines of a basket.
LINE_ORDER = ("ord_line", "ord_part", "ord_supp", "ord_qty", "ord_price")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(value: Column) -> Column:
    return F.round(value, 2).cast(MONEY)


def _basket(order_key: Column) -> Column:
    return F.concat(F.lit("SQ"), order_key.cast("string"))


def joined_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines with the cells of their parts and orders that ``sales_columns`` needs, and their day.

    The lines are not sorted for the joins: a task looks them up in its part of the parts,
    and then of the orders.  Orders come last and are found by the basket's name, so that
    the lines of a basket are together and groupings by basket need no further shuffle; the
    name itself is not shuffled, the key that it is made of is.
    """
    sold = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.col("l_quantity").cast("bigint").alias("l_quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("l_extendedprice"),
        F.col("l_discount").cast("decimal(4,2)").alias("l_discount"),
        F.col("l_tax").cast("decimal(4,2)").alias("l_tax"),
    )
    named = sold.join(table(spark, folder, "part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    baskets = table(spark, folder, "orders").hint("shuffle_hash")
    return named.join(baskets, _basket(F.col("l_orderkey")) == _basket(F.col("o_orderkey"))).select(
        "o_orderkey",
        "o_orderdate",
        F.to_date("o_orderdate").alias("date"),
        "o_orderpriority",
        "o_custkey",
        "p_name",
        "p_type",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


def sales_columns(joined: DataFrame) -> DataFrame:
    """Typed sales lines, in the shape that cleaning produces, with their order columns; row by row."""
    gross = F.col("l_extendedprice")
    seconds = 25200 + (F.col("o_orderkey") * 7919) % 54000
    amounts = joined.select(
        _basket(F.col("o_orderkey")).alias("transaction_id"),
        F.concat(F.lit("PMT"), F.col("o_orderkey").cast("string")).alias("payment_id"),
        "date",
        (F.col("o_orderdate") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("transaction_ts"),
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("item"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").alias("qty"),
        F.lit("Regular").alias("price_point_name"),
        gross.alias("gross_sales"),
        (-_cents(gross * F.col("l_discount"))).cast(MONEY).alias("discounts"),
        F.col("l_tax").alias("_rate"),
        F.col("o_orderpriority").alias("device_name"),
        F.lit("Main").alias("location"),
        F.col("o_custkey").alias("customer_no"),
        F.col("l_linenumber").alias("ord_line"),
        F.col("l_partkey").alias("ord_part"),
        F.col("l_suppkey").alias("ord_supp"),
        F.col("l_quantity").alias("ord_qty"),
        gross.alias("ord_price"),
    )
    return (
        amounts.withColumn("net_sales", (F.col("gross_sales") + F.col("discounts")).cast(MONEY))
        .withColumn("tax", _cents(F.col("net_sales") * F.col("_rate")))
        .drop("_rate")
    )


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sales lines of the whole folder; lines of a basket are together."""
    return sales_columns(joined_lines(spark, folder))


def money_text(value: Column) -> Column:
    """12.34 -> ``$12.34``, -1.23 -> ``-$1.23``."""
    digits = F.abs(value).cast(MONEY).cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), digits)


def time_text(ts: Column, pattern: str | None = None) -> Column:
    """Clock text in the twelve-hour form, from the fields of a zone-free timestamp.

    Without a ``printf`` pattern the text is put together as ``02:30:00 PM``.
    """
    hour = F.hour(ts)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    half = F.when(hour < 12, "AM").otherwise("PM")
    if pattern is not None:
        return F.format_string(pattern, twelve, F.minute(ts), F.second(ts), half)
    # An absent field is written as ``printf`` writes it.
    fields = (twelve, F.minute(ts), F.second(ts))
    two = [F.coalesce(F.lpad(field.cast("string"), 2, "0"), F.lit("null")) for field in fields]
    return F.concat(F.concat_ws(":", *two), F.lit(" "), half)


def raw_export(spark: SparkSession, folder: str, *, faults: bool = False) -> DataFrame:
    """The same lines as an export writes them: 23 text columns, plus the order columns.

    ``faults`` spoils the quantity, gross sales, date or discount of the lines of
    some parts, the way a damaged export would.
    """
    part = F.col("ord_part")

    def spoiled(text: Column, divisor: int, bad: str) -> Column:
        return F.when(part % divisor == 0, bad).otherwise(text) if faults else text

    cells = {
        "Date": spoiled(F.date_format("date", "MM/dd/yyyy"), 83, "02/30/2025"),
        "Time": time_text(F.col("transaction_ts")),
        "Time Zone": F.lit("America/Chicago"),
        "Category": F.col("category"),
        "Item": F.col("item"),
        "SKU": F.col("sku"),
        "Qty": spoiled(F.col("qty").cast("string"), 97, "three"),
        "Price Point Name": F.col("price_point_name"),
        "Gross Sales": spoiled(money_text(F.col("gross_sales")), 89, "$$12.00"),
        "Discounts": spoiled(money_text(F.col("discounts")), 79, "N/A"),
        "Net Sales": money_text(F.col("net_sales")),
        "Tax": money_text(F.col("tax")),
        "Transaction ID": F.col("transaction_id"),
        "Payment ID": F.col("payment_id"),
        "Device Name": F.col("device_name"),
        "Notes": F.lit(None).cast("string"),
        "Details": F.lit(None).cast("string"),
        "Event Type": F.lit("Payment"),
        "Location": F.col("location"),
        "Dining Option": F.lit(None).cast("string"),
        "Customer Name": F.concat(F.lit("Customer "), F.col("customer_no").cast("string")),
        "Customer ID": F.concat(F.lit("CUST"), F.col("customer_no").cast("string")),
        "Customer Reference ID": F.md5(F.col("customer_no").cast("string").cast("binary")),
    }
    return sales_lines(spark, folder).select(*(cells[name].alias(name) for name in RAW_COLUMNS), *LINE_ORDER)


def part_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One stockout window of 8 to 22 days per part."""
    part = F.col("p_partkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), ((part * 37) % 2300).cast("int"))
    return (
        table(spark, folder, "part")
        .select(F.concat(F.lit("P-"), part.cast("string")).alias("sku"), start.alias("start_date"), part.alias("_part"))
        .withColumn("end_date", F.date_add("start_date", (7 + F.col("_part") % 15).cast("int")))
        .drop("_part")
    )


def event_slots(spark: SparkSession, folder: str) -> DataFrame:
    """The events as baskets: date, hour and weekday of each."""
    from tillscope.functions.calendar import weekday_name

    ts = F.col("ts")
    return table(spark, folder, "events").select(
        F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), weekday_name(ts).alias("weekday")
    )
