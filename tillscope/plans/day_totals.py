"""Headline KPIs of any range of days from stored daily totals, without reading lines.

Sums add up over days; different baskets and items do not.  Their names are given
numbers once, and a day holds the set of its numbers as bitmaps: one row per day, kind
and bucket of 32,768 numbers.  Bitmaps of days are united by ``bitmap_or_agg`` and
counted, which is exact for every range.  Numbers follow the first day of a name, so a
day's own baskets lie in few buckets.

Lines without a day belong to no range and are left out; null names are not counted,
null amounts add nothing.  An empty table gives zeros for every range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.calendar import DateLike, between_dates
from tillscope.functions.numbers import total

SUMS, SETS = "day_sums", "day_sets"
KINDS = {"transactions": "transaction_id", "distinct_items": "item"}


def _numbers(pairs: DataFrame, folder: str, kind: str) -> DataFrame:
    """(name, number): different numbers that follow the first day of the name."""
    spark = pairs.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = pairs.groupBy("name").agg(F.min("date").alias("first"))
    numbered = first.repartitionByRange(slices, "first", "name").sortWithinPartitions("first", "name")
    path = f"{folder}/numbers_{kind}"
    # Stored, so that a number stays what it is.
    numbered.select("name", F.monotonically_increasing_id().alias("number")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_day_totals(lines: DataFrame, folder: str) -> None:
    """Write the daily sums and sets of line items to ``folder``."""
    spark = lines.sparkSession
    dated = lines.where(F.col("date").isNotNull())
    sums = dated.groupBy("date").agg(total(F.col("net_sales")).alias("net_sales"), total(F.col("qty")).alias("units"))
    sums.write.mode("overwrite").parquet(f"{folder}/{SUMS}")
    sets = []
    for kind, column in KINDS.items():
        path = f"{folder}/pairs_{kind}"
        names = dated.select("date", F.col(column).alias("name")).where(F.col("name").isNotNull())
        names.distinct().write.mode("overwrite").parquet(path)
        pairs = spark.read.parquet(path)
        numbers = pairs.join(_numbers(pairs, folder, kind), "name").select("date", "number")
        bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
        sets.append(
            numbers.groupBy("date", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(bitmap)
            .select("date", F.lit(kind).alias("kind"), "bucket", "bitmap")
        )
    sets[0].unionByName(sets[1]).write.mode("overwrite").parquet(f"{folder}/{SETS}")


def kpis_of_days(spark: SparkSession, folder: str, start: DateLike, end: DateLike) -> DataFrame:
    """The row of ``headline_kpis`` for a range, from the stored totals alone."""
    sums = between_dates(spark.read.parquet(f"{folder}/{SUMS}"), start, end)
    sets = between_dates(spark.read.parquet(f"{folder}/{SETS}"), start, end)
    united = sets.groupBy("kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("names"))
    counted = united.agg(
        F.struct(*(total(F.when(F.col("kind") == kind, F.col("names"))).alias(kind) for kind in KINDS))
    ).scalar()
    row = sums.agg(total(F.col("net_sales")).alias("net_sales"), total(F.col("units")).alias("units"))
    row = row.withColumn("_sets", counted).select("net_sales", "units", "_sets.*")
    average = F.when(F.col("transactions") == 0, 0.0).otherwise(F.col("net_sales").cast("double") / F.col("transactions"))
    return row.select("net_sales", "transactions", average.alias("avg_basket"), "units", "distinct_items")
