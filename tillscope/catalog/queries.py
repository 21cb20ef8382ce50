"""The registered queries: every operator over the whole given tables.

Each takes ``(spark, folder)`` and returns a DataFrame of plain types (text,
bigint, double, boolean), so that any SQL engine can state the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.calendar import MONTH
from tillscope.functions.parsing import parse_money, parse_number
from tillscope.names import MONEY, PRIVATE_COLUMNS
from tillscope.operators import compare, contract, sampling, stockouts
from tillscope.operators.cleaning import clean, normalize_headers, parse_datetime
from tillscope.plans import differences, metrics, profile, reconcile
from tillscope.plans.day_totals import kpis_of_days, save_day_totals
from tillscope.plans.tables import build_daily_item_sales, build_line_items, build_tables, build_transactions, line_values
from tillscope.session import scratch_path, storing
from tillscope.sources import order_lines
from tillscope.sources.order_lines import LINE_ORDER
from tillscope.sources.sales_csv import ingest_csv, read_sales_csv, write_sales_csv
from tillscope.sources.tables import build_and_load, load_views, query_table, save_tables, store_together, stored_date_bounds

# The whole span of the order dates, a part of it, and a day before it.
FULL = ("1995-01-01", "2001-12-31")
PART = ("1997-04-10", "1999-08-20")
BEFORE = ("1990-01-01", "1990-01-01")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, integers as bigint, days and times as ISO text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(spark, folder))

    QUERIES[build.__name__] = run
    return run


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return order_lines.sales_lines(spark, folder)


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    return build_transactions(_lines(spark, folder), LINE_ORDER)


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return build_daily_item_sales(_lines(spark, folder), LINE_ORDER)


def _cleaned_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    return clean(order_lines.raw_export(spark, folder, faults=True))


# --- ingestion -------------------------------------------------------------


@query
def clean_line_items(spark, folder):
    return _cleaned_with_faults(spark, folder)


@query
def csv_round_trip(spark, folder):
    """Write the export as CSV files, then scan and clean them."""
    path = scratch_path(spark, "export")
    write_sales_csv(order_lines.raw_export(spark, folder, faults=True), path, compression="lz4")
    cleaned = ingest_csv(spark, path).drop("source_file", "source_row")
    types = {name: MONEY if name == "ord_price" else "bigint" for name in LINE_ORDER}
    return cleaned.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


@query
def csv_pruned_scan(spark, folder):
    """Net sales text and basket per line from a scan of two raw columns."""
    path = scratch_path(spark, "export")
    write_sales_csv(order_lines.raw_export(spark, folder), path, compression="lz4")
    rows = read_sales_csv(spark, path, ["Transaction ID", "Net Sales"], ragged="truncate", keep_order=False)
    return normalize_headers(rows)


@query
def raw_currency_parse(spark, folder):
    amount = F.col("gross_sales").cast("string")
    shapes = [
        F.concat(F.lit("$"), amount),
        F.concat(F.lit("-$"), amount),
        F.concat(F.lit("  $"), amount, F.lit(" ")),
        F.concat(F.lit("$$"), amount),
        F.concat(F.lit("($"), amount, F.lit(")")),
        amount,
        F.concat(F.lit("$-"), amount),
        F.lit("N/A"),
        F.lit(""),
        F.concat(F.lit("$"), F.format_number("gross_sales", 2)),
        F.concat(F.lit("$"), F.floor("gross_sales").cast("string")),
        F.concat(F.lit("$"), amount, F.lit("0")),
        F.lit("twelve dollars"),
    ]
    text = F.get(F.array(*shapes), (F.col("ord_part") % 13).cast("int"))
    return _lines(spark, folder).select(*LINE_ORDER, "transaction_id", parse_money(text).alias("amount"))


@query
def raw_timestamp_parse(spark, folder):
    ts, day = F.col("transaction_ts"), F.date_format("date", "MM/dd/yyyy")
    year = F.date_format("date", "yyyy")
    clock = order_lines.time_text(ts)
    shapes = [
        (day, clock),
        (F.date_format("date", "M/d/yyyy"), order_lines.time_text(ts, "%d:%d:%d %s")),
        (day, F.lower(clock)),
        (F.concat(F.lit(" "), day, F.lit("  ")), F.concat(F.lit("\t"), clock, F.lit(" "))),
        (F.concat(F.lit("13/45/"), year), clock),
        (F.concat(F.lit("02/30/"), year), clock),
        (F.lit("Not a date"), clock),
        (day, F.lit("00:10:00 AM")),
        (day, F.lit("14:05:00")),
        (day, F.lit(None).cast("string")),
        (day, order_lines.time_text(ts, "%02d:%02d:%02d   %s")),
    ]
    at = (F.col("ord_part") % len(shapes)).cast("int")
    texts = _lines(spark, folder).select(
        *LINE_ORDER,
        "transaction_id",
        F.get(F.array(*(d for d, _ in shapes)), at).alias("date"),
        F.get(F.array(*(t for _, t in shapes)), at).alias("time"),
    )
    return parse_datetime(texts).drop("time")


@query
def raw_date_only_parse(spark, folder):
    """Exports without a time column: the day at midnight."""
    raw = order_lines.raw_export(spark, folder, faults=True).drop("Time")
    return clean(raw).select(*LINE_ORDER, "transaction_id", "date", "transaction_ts")


@query
def raw_qty_parse(spark, folder):
    qty = F.col("qty").cast("string")
    shapes = [
        qty,
        F.concat(F.lit(" "), qty, F.lit(" ")),
        F.concat(qty, F.lit(".0")),
        F.concat(qty, F.lit("d")),
        F.lit("inf"),
        F.lit("nan"),
        F.lit("three"),
        F.lit(""),
        F.concat(qty, F.lit("e0")),
    ]
    text = F.get(F.array(*shapes), (F.col("ord_part") % len(shapes)).cast("int"))
    return _lines(spark, folder).select(*LINE_ORDER, "transaction_id", parse_number(text).alias("qty"))


# --- contract --------------------------------------------------------------


def _out_of_contract(spark, folder):
    part = F.col("ord_part")
    return _cleaned_with_faults(spark, folder).withColumns(
        {
            "qty": F.when(part % 73 == 0, 0.0).otherwise(F.col("qty")),
            "tax": F.when(part % 71 == 0, F.col("tax") - 1000000).otherwise(F.col("tax")),
            "item": F.when(part % 67 != 0, F.col("item")),
        }
    )


@query
def contract_failures(spark, folder):
    return contract.failures(_out_of_contract(spark, folder), ["transaction_id", *LINE_ORDER])


@query
def contract_summary(spark, folder):
    broken = contract.summary(_out_of_contract(spark, folder)).withColumn("data", F.lit("damaged"))
    intact = contract.summary(clean(order_lines.raw_export(spark, folder))).withColumn("data", F.lit("intact"))
    return broken.unionByName(intact)


@query
def missing_column_report(spark, folder):
    """A damaged export that lacks two required columns and has two of a wrong type: failures per column and check."""
    raw = order_lines.raw_export(spark, folder, faults=True).drop("SKU", "Net Sales")
    cleaned = clean(raw).withColumns({"item": F.length("item"), "date": F.col("date").cast("string")})
    return contract.failures(cleaned).groupBy("scope", "column", "check").agg(F.count("*").alias("failures"))


@query
def quarantine_split(spark, folder):
    good, bad = contract.split_valid(_out_of_contract(spark, folder), staging=scratch_path(spark, "marked"))
    good = good.select("transaction_id", *LINE_ORDER, F.lit(0).alias("failures"))
    return good.unionByName(bad.select("transaction_id", *LINE_ORDER, F.size("failures").alias("failures")))


@query
def private_columns(spark, folder):
    """Lines of the export, and how many private columns reach the three tables."""
    cleaned = clean(order_lines.raw_export(spark, folder))
    tables = build_and_load(cleaned, LINE_ORDER, check=False)
    leaked = sum(not contract.private_columns_absent(df, PRIVATE_COLUMNS) for df in tables.values())
    return query_table(spark, "line_items").agg(F.count("*").alias("lines"), F.lit(leaked).alias("tables_with_private"))


# --- tables ----------------------------------------------------------------


@query
def line_items(spark, folder):
    return build_line_items(_lines(spark, folder), LINE_ORDER)


@query
def transactions(spark, folder):
    return _baskets(spark, folder)


@query
def daily_item_sales(spark, folder):
    return _daily(spark, folder)


def _patchy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that lack headers and items here and there, and name others where they have them."""
    part, basket, line = F.col("ord_part"), F.col("transaction_id"), F.col("ord_line").cast("string")
    return _lines(spark, folder).withColumns(
        {
            "payment_id": F.when(part % 3 == 0, F.concat("payment_id", F.lit("-"), line)),
            "device_name": F.when(part % 2 == 1, F.concat("device_name", F.lit("/"), "sku")),
            "location": F.when(part % 50 == 7, F.concat(F.lit("Aisle "), line)),
            "item": F.when(F.col("ord_line") % 2 == 0, F.concat("item", F.lit(" "), basket)),
            "category": F.when(part % 5 != 0, F.concat("category", F.lit(" "), line)),
        }
    )


@query
def transactions_patchy_headers(spark, folder):
    """The first header of a basket that is there, in row order, is not always its first line's."""
    baskets = build_transactions(_patchy_lines(spark, folder), LINE_ORDER)
    return baskets.select("transaction_id", "num_line_items", "payment_id", "device_name", "location")


@query
def daily_patchy_items(spark, folder):
    daily = build_daily_item_sales(_patchy_lines(spark, folder), LINE_ORDER)
    return daily.select("date", "sku", "item", "category", "units_sold", "transactions_count")


@query
def stored_tables(spark, folder):
    """Export to stored tables and back: rows and net sales of each."""
    cleaned = clean(order_lines.raw_export(spark, folder))
    build_and_load(cleaned, LINE_ORDER, folder=scratch_path(spark, "tables"), by_month=True, together=True)
    return spark.sql(
        """
        SELECT 'line_items' AS table_name, count(*) AS row_count, sum(net_sales) AS net_sales FROM line_items
        UNION ALL
        SELECT 'transactions', count(*), sum(total_net_sales) FROM transactions
        UNION ALL
        SELECT 'daily_item_sales', count(*), sum(net_sales) FROM daily_item_sales
        """
    )


@query
def units_by_category_sql(spark, folder):
    """Ad-hoc SQL over the registered tables."""
    load_views({"daily_item_sales": _daily(spark, folder)})
    return spark.sql("SELECT category, SUM(units_sold) AS units FROM daily_item_sales GROUP BY category")


# --- reports ---------------------------------------------------------------


@query
def date_bounds(spark, folder):
    return metrics.date_bounds(_lines(spark, folder))


@query
def date_bounds_of_footers(spark, folder):
    """The same bounds from the footers of the stored lines."""
    path = scratch_path(spark, "bounds")
    save_tables({"line_items": _lines(spark, folder).select("transaction_id", "date", "net_sales")}, path, by_month=True)
    return stored_date_bounds(spark, f"{path}/line_items")


@query
def kpis_full(spark, folder):
    return metrics.headline_kpis(_lines(spark, folder), *FULL)


@query
def kpis_range(spark, folder):
    return metrics.headline_kpis(_lines(spark, folder), *PART)


@query
def kpis_empty_range(spark, folder):
    return metrics.headline_kpis(_lines(spark, folder), *BEFORE)


@query
def kpis_from_day_totals(spark, folder):
    """Three ranges from stored daily sums and sets; the lines are read once, to store them."""
    path = scratch_path(spark, "day-totals")
    save_day_totals(_lines(spark, folder), path)
    ranges = {"full": FULL, "part": PART, "before": BEFORE}
    rows = [kpis_of_days(spark, path, *days).withColumn("label", F.lit(label)) for label, days in ranges.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def kpi_cards(spark, folder):
    return metrics.kpi_cards(metrics.headline_kpis(_lines(spark, folder), *FULL))


@query
def category_mix(spark, folder):
    return metrics.category_mix(_lines(spark, folder), *FULL)


@query
def category_mix_range(spark, folder):
    return metrics.category_mix(_lines(spark, folder), *PART)


@query
def category_mix_ascending(spark, folder):
    return metrics.category_mix_ascending(_lines(spark, folder), *FULL)


@query
def hour_weekday_grid(spark, folder):
    return metrics.hour_weekday_counts(_baskets(spark, folder), *PART)


@query
def hour_weekday_grid_empty(spark, folder):
    return metrics.hour_weekday_counts(_baskets(spark, folder), *BEFORE)


@query
def hour_weekday_grid_events(spark, folder):
    return metrics.hour_weekday_counts(order_lines.event_slots(spark, folder), "2024-01-01", "2024-12-31")


@query
def hour_weekday_pivot(spark, folder):
    return metrics.hour_weekday_matrix(metrics.hour_weekday_counts(_baskets(spark, folder), *FULL))


@query
def month_over_month(spark, folder):
    return metrics.month_over_month(_lines(spark, folder), *FULL)


@query
def month_over_month_gaps(spark, folder):
    """All sales booked in the first month of their quarter: the change spans the months without sales."""
    booked = _lines(spark, folder).withColumn("date", F.trunc("date", "quarter"))
    return metrics.month_over_month(booked, *FULL)


@query
def top_items_by_units(spark, folder):
    return metrics.top_items_by_units(_lines(spark, folder), *PART)


@query
def top_items_by_sales(spark, folder):
    return metrics.top_items_by_sales(_lines(spark, folder), *PART)


@query
def top_skus_by_units(spark, folder):
    return metrics.top_skus_by_units(_daily(spark, folder))


@query
def units_by_category_from_rollup(spark, folder):
    return metrics.units_by_category(_daily(spark, folder))


# --- profile ---------------------------------------------------------------


@query
def dataset_summary(spark, folder):
    return profile.dataset_summary(_lines(spark, folder), _baskets(spark, folder))


@query
def daily_totals(spark, folder):
    return profile.daily_totals(_lines(spark, folder))


@query
def weekend_vs_weekday(spark, folder):
    return profile.weekend_lift(_lines(spark, folder))


@query
def first_of_month_vs_other(spark, folder):
    return profile.month_opening_lift(_lines(spark, folder))


@query
def category_season_daily_mean(spark, folder):
    return profile.category_summer_lift(_lines(spark, folder), "PROMO")


@query
def category_share_rounded(spark, folder):
    return profile.category_share(_lines(spark, folder))


@query
def row_count_tolerance(spark, folder):
    """Lines whose cells all parse, against the lines of the raw export."""
    raw = order_lines.raw_export(spark, folder, faults=True)
    cleaned = clean(raw)
    return profile.row_count_check(cleaned, raw, where=contract.failure_mask(cleaned) == 0)


# --- stockout windows ------------------------------------------------------


@query
def window_calendar(spark, folder):
    return stockouts.window_days(order_lines.part_windows(spark, folder))


@query
def sale_days_in_windows(spark, folder):
    return stockouts.sale_days_in_windows(_daily(spark, folder), order_lines.part_windows(spark, folder))


@query
def stockout_violations(spark, folder):
    inside = stockouts.sales_inside_windows(_daily(spark, folder), order_lines.part_windows(spark, folder))
    return inside.select("date", "sku", "units_sold", "net_sales")


@query
def sales_outside_windows(spark, folder):
    outside = stockouts.sales_outside_windows(_lines(spark, folder), order_lines.part_windows(spark, folder))
    return outside.groupBy("category").agg(F.count("*").alias("lines"), F.sum("net_sales").alias("net_sales"))


@query
def out_of_stock_flags(spark, folder):
    flagged = stockouts.flag_out_of_stock(_lines(spark, folder), order_lines.part_windows(spark, folder))
    return flagged.select("transaction_id", "date", "sku", *LINE_ORDER, "out_of_stock")


# --- sampling and checks ---------------------------------------------------


@query
def sample_whole_baskets(spark, folder):
    """The lines of one basket in ten, drawn day by day."""
    sample = sampling.sample_baskets(_lines(spark, folder), 0.1, seed=42)
    return sample.select("transaction_id", "date", "sku", *LINE_ORDER, "net_sales")


@query
def sample_completeness(spark, folder):
    """Baskets per day before and after the draw, and sampled baskets that are not whole (none)."""
    path = scratch_path(spark, "sample")
    lines = _lines(spark, folder).select("transaction_id", "date")
    sampling.sample_baskets(lines, 0.1, seed=42).write.parquet(path)
    sample = spark.read.parquet(path)
    broken = reconcile.whole_baskets(lines, sample).agg(F.count("*")).scalar()
    per_day = lines.groupBy("date").agg(F.count_distinct("transaction_id").alias("baskets"))
    kept = sample.groupBy("date").agg(F.count_distinct("transaction_id").alias("kept"))
    return per_day.join(kept, "date", "left").withColumn("split_baskets", broken)


@query
def check_ranges(spark, folder):
    return reconcile.check_ranges(reconcile.raw_date_bounds(order_lines.raw_export(spark, folder)))


def _reconciliation(spark, folder):
    """KPIs use no line numbers; the text is rendered once and read twice, by either side.

    Only cells that one of the sides reads are rendered: the time of day is the one that
    cleaning needs beside those of the independent side.
    """
    path = scratch_path(spark, "raw")
    order_lines.raw_export(spark, folder).select(*reconcile.RAW_KPI_COLUMNS, "Time").write.parquet(path)
    raw = spark.read.parquet(path)
    return reconcile.reconcile_kpis(raw, line_values(clean(raw)))


@query
def kpi_reconciliation(spark, folder):
    return _reconciliation(spark, folder)


@query
def export_reconciliation(spark, folder):
    """From CSV files through stored tables, and once more from the text of the files."""
    export = scratch_path(spark, "export")
    write_sales_csv(order_lines.raw_export(spark, folder).drop(*LINE_ORDER), export, compression="lz4")
    tables = build_and_load(ingest_csv(spark, export), folder=scratch_path(spark, "tables"))
    return reconcile.reconcile_export(spark, export, tables["line_items"])


@query
def reconciliation_verdict(spark, folder):
    return compare.verdict(_reconciliation(spark, folder))


@query
def grain_consistency(spark, folder):
    """Over stored tables: each is built once, from lines that are put together once and kept so."""
    path = scratch_path(spark, "grains")
    tables = build_tables(store_together(_lines(spark, folder), f"{path}/lines"), LINE_ORDER, True)
    save_tables(tables, path)
    names = ["line_items", "transactions", "daily_item_sales"]
    return reconcile.grain_checks(*(spark.read.parquet(f"{path}/{name}") for name in names))


@query
def basket_comparison(spark, folder):
    """Basket totals against sums of their lines, key by key; the second source has other units on Sundays."""
    lines = _lines(spark, folder)
    summed = lines.groupBy("transaction_id").agg(
        F.sum("qty").alias("total_qty"), F.sum("gross_sales").alias("total_gross_sales")
    )
    more = F.when(F.col("weekday") == "Sunday", 1).otherwise(0)
    other = _baskets(spark, folder).withColumn("total_qty", F.col("total_qty") + more)
    aligned = compare.align(summed, other, ["transaction_id"], ["total_qty", "total_gross_sales"])
    return aligned.groupBy("value_name", "status").agg(F.count("*").alias("baskets"))


def _spoiled(lines):
    """Another version of the lines: other quantities in some baskets, a first line lost or repeated in others."""
    basket = F.substring("transaction_id", 3, 20).cast("bigint")
    other = lines.withColumn("qty", F.when(basket % 997 == 0, F.col("qty") + 1).otherwise(F.col("qty")))
    kept = other.where(~((basket % 1009 == 1) & (F.col("ord_line") == 1)))
    return kept.unionByName(other.where((basket % 1013 == 2) & (F.col("ord_line") == 1)))


@query
def differing_baskets(spark, folder):
    """Baskets that differ between stored lines and another version of them, found from the months down."""
    path = scratch_path(spark, "versions")
    rows = order_lines.joined_lines(spark, folder)
    save_tables({"own": rows}, path, by_month=True, finish=order_lines.sales_columns)
    # Read from its months again, so a task writes to few of them.
    other = _spoiled(spark.read.parquet(f"{path}/own"))
    with storing(spark):
        other.write.partitionBy(MONTH).parquet(f"{path}/other")
    return differences.find_differences(*(spark.read.parquet(f"{path}/{name}") for name in ("own", "other")))


@query
def key_set_differences(spark, folder):
    """Skus with their category in the catalogue and as sold, where every tenth was sold under another."""
    part = order_lines.table(spark, folder, "part")
    catalogue = part.select(F.concat(F.lit("P-"), F.col("p_partkey")).alias("sku"), F.col("p_type").alias("category"))
    renamed = F.when(F.col("ord_part") % 10 == 0, "OTHER").otherwise(F.col("category"))
    sold = _lines(spark, folder).select("sku", renamed.alias("category"))
    return compare.key_differences(catalogue, sold)


@query
def key_multiset_differences(spark, folder):
    """Skus line by line, as sold and where lines of some parts are lost and those of others come twice."""
    lines = _lines(spark, folder)
    lost, twice = lines.where(F.col("ord_part") % 10 != 0), lines.where(F.col("ord_part") % 25 == 0)
    columns = ["sku", "category"]
    return compare.key_multiset_differences(lines.select(*columns), lost.unionByName(twice).select(*columns))


@query
def common_key_set(spark, folder):
    """Items that were sold in the category that the catalogue lists with the next part."""
    sold = _lines(spark, folder).select("item", "category")
    part = order_lines.table(spark, folder, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("category"))
    listed = part.join(after, "p_partkey").select(F.col("p_name").alias("item"), "category")
    return compare.common_keys(sold, listed)


@query
def opening_lines(spark, folder):
    """The first twenty lines by day, time and basket."""
    return metrics.head(_lines(spark, folder), 20, ["date", "transaction_ts", "transaction_id", *LINE_ORDER]).select(
        "transaction_id", "date", "sku", *LINE_ORDER
    )


@query
def month_change_check(spark, folder):
    """The month-over-month change worked out apart, from a join of each month with the one before."""
    return reconcile.independent_trend(order_lines.raw_export(spark, folder))
