"""Named tables: temporary views for a session, Parquet folders for keeps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.functions.calendar import MONTH, month_start
from tillscope.names import NUMBERED_ORDER, ROW_ORDER, TABLES
from tillscope.operators.contract import require_valid, store_rows, write_valid
from tillscope.plans.tables import build_daily_item_sales, build_line_items, build_tables, build_transactions
from tillscope.session import session_conf as _conf
from tillscope.session import storing


LOADS = "load string, number int"


def load_views(tables: Mapping[str, DataFrame]) -> None:
    """Create or replace one temporary view per table, ready for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def save_tables(
    tables: Mapping[str, DataFrame],
    folder: str,
    *,
    by_month: bool = False,
    mode: str = "overwrite",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write each table to ``folder/<name>`` as Parquet.

    ``by_month`` lays tables with a ``date`` out in one sub-folder per calendar
    month, for sources of many years.  Rows are rebalanced on the month first:
    files come out at a good size and a month that outgrows the others is split.

    ``finish`` works out the columns of the tables from narrower rows, row by row.  It is
    applied after the rebalancing, so that only the narrow rows are shuffled.
    """
    for name, df in tables.items():
        months = by_month and "date" in df.columns
        if months:
            df = df.withColumn(MONTH, month_start(F.col("date"))).hint("rebalance", MONTH)
        if finish is not None:
            df = finish(df)
        if months and MONTH not in df.columns:
            df = df.withColumn(MONTH, month_start(F.col("date")))
        writer = df.write.mode(mode)
        with storing(df.sparkSession):
            (writer.partitionBy(MONTH) if months else writer).parquet(f"{folder}/{name}")


def store_together(rows: DataFrame, path: str, key: str = "transaction_id") -> DataFrame:
    """Write the rows in buckets of ``key`` and open them, so that groupings by it shuffle no rows.

    For rows that a join or grouping by the key has put together already: of others, each
    task would write to every bucket.  A bucket is read by one task.  Spark keeps buckets
    with the name of a table, so the rows have one until they are open; the files stay.
    """
    spark, name = rows.sparkSession, f"together_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        with storing(spark):
            rows.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def open_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Read saved tables back and register them as views of the same names.

    In a folder that ``build_and_load`` keeps, these are the tables of the last
    complete load.
    """
    load = current_load(spark, folder)
    tables = {name: spark.read.parquet(f"{load or folder}/{name}") for name in names}
    load_views(tables)
    return tables


def current_load(spark: SparkSession, folder: str) -> str | None:
    """Folder of the last load that was finished; None if the folder has no list of loads."""
    try:
        loads = spark.read.schema(LOADS).parquet(f"{folder}/loads")
        last = loads.orderBy(F.desc("number"), "load").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return f"{folder}/{last['load']}" if last else None


def _finish_load(spark: SparkSession, folder: str, load: str) -> None:
    """One row appended to the list of loads makes a load the current one."""
    spark.createDataFrame([], LOADS).coalesce(1).write.mode("ignore").parquet(f"{folder}/loads")
    done = spark.read.schema(LOADS).parquet(f"{folder}/loads").count()
    row = spark.createDataFrame([(load, done + 1)], LOADS)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/loads")


# The reader that answers minima and maxima from footers, and its switch.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def stored_date_bounds(spark: SparkSession, path: str) -> DataFrame:
    """First and last day of a stored table, today for both when it has none.

    The bounds come from the statistics in the footers of the files; no column is read.
    A file whose days are all null has none, so then the column is read after all.  The
    answer is worked out at once and is one row.
    """
    with _conf(spark, FOOTERS):
        days = spark.read.parquet(path).agg(F.min("date").alias("first"), F.max("date").alias("last"))
        try:
            found = days.first()
        except Py4JJavaError as error:
            if "No min/max found" not in str(error):
                raise
            found = None
    if found is None:
        found = spark.read.parquet(path).agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    bounds = spark.createDataFrame([tuple(found)], "first date, last date")
    return bounds.select(
        F.coalesce("first", F.current_date()).alias("min_date"), F.coalesce("last", F.current_date()).alias("max_date")
    )


def query_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _number_files(rows: DataFrame, path: str) -> DataFrame:
    """The rows with their files as numbers in the order of the paths, which sort faster than paths.

    A row without a file keeps a null, which comes first in either order.
    """
    file, number = ROW_ORDER[0], NUMBERED_ORDER[0]
    # One row per file.
    files = rows.where(F.col(file).isNotNull()).select(file).distinct()
    with storing(rows.sparkSession):
        files.withColumn(number, F.row_number().over(Window.orderBy(file))).write.mode("overwrite").parquet(path)
    return rows.join(F.broadcast(rows.sparkSession.read.parquet(path)), file, "left")


def build_and_load(
    cleaned: DataFrame,
    order: Sequence[str] | None = None,
    *,
    folder: str | None = None,
    check: bool = True,
    by_month: bool = False,
    together: bool = False,
) -> dict[str, DataFrame]:
    """Check the contract, build the three tables and make them available by name.

    With ``folder`` the cleaned rows and the tables are written to a fresh folder
    below it, so the text is parsed once and each table is computed once.  When all
    of them are there, the load becomes the current one; a load that is rejected or
    fails leaves the tables before it as they were.  Earlier loads stay on disk for
    readers that still use them.  Without ``folder`` the views are lazy and each query
    computes what it needs.

    ``together`` says that a join or grouping has put the lines of each basket together:
    they are kept so, in buckets, and are not shuffled by basket again.
    """
    if folder is None:
        if check:
            require_valid(cleaned)
        tables = build_tables(cleaned, order)
        load_views(tables)
        return tables

    spark, load = cleaned.sparkSession, f"load-{uuid.uuid4().hex}"
    target = f"{folder}/{load}"
    staged = f"{target}/cleaned"
    store = store_together if together else store_rows
    rows = write_valid(cleaned, staged, store=store) if check else store(cleaned, staged)
    if order is None and set(ROW_ORDER) <= set(rows.columns) and NUMBERED_ORDER[0] not in rows.columns:
        rows, order = _number_files(rows, f"{target}/files"), NUMBERED_ORDER
    # The rollup shuffles most, so it comes while the least is on disk.
    save_tables({"daily_item_sales": build_daily_item_sales(rows, order, True)}, target, by_month=by_month)
    save_tables({"line_items": build_line_items(rows, order)}, target, by_month=by_month)
    save_tables({"transactions": build_transactions(rows, order)}, target, by_month=by_month)
    _finish_load(spark, folder, load)
    return open_tables(spark, folder, TABLES)
