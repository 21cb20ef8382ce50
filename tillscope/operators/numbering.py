"""Running numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import scratch_path, storing


# Rows of a group that one task numbers; what is larger is cut into slices.
HOT_ROWS = 1_000_000


def number_rows(df: DataFrame, key: str, order: Sequence[str], name: str = "row_no", hot: int = HOT_ROWS) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... within ``key``, following ``order``; rows without a key get none.

    Groups are counted first, from their keys alone.  Those of at most ``hot`` rows
    are numbered by one shuffle of the rows.  Rows of larger groups are cut into
    consecutive slices by key and order, whatever the groups: they are numbered within
    their slice, and a group that reaches over a border goes on after its rows in the
    slices before.  Only these rows are stored, in the shared folder, so that a slice
    stays what it is when an executor is lost.
    """
    keyed = F.col(key).isNotNull()
    sizes = df.where(keyed).groupBy(key).agg(F.count("*").alias("_rows"))
    # At most one key per ``hot`` rows of the table.
    large = _stored(sizes.where(F.col("_rows") > hot).select(key), "hot-keys")
    if large.isEmpty():
        return _numbered(df, key, order, name)
    rest = df.join(large, key, "left_anti").select(*df.columns)
    return _numbered(rest, key, order, name).unionByName(
        _numbered_by_slices(df.join(large, key, "left_semi").select(*df.columns), key, order, name)
    )


def _numbered(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    # Rows without a key are dealt by their order, so that they are no group.
    apart = F.when(F.col(key).isNull(), F.xxhash64(*order))
    place = F.row_number().over(Window.partitionBy(key, apart).orderBy(*order)).cast("bigint")
    return df.withColumn(name, F.when(F.col(key).isNotNull(), place))


def _numbered_by_slices(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    spark = df.sparkSession
    taken = {column.lower() for column in df.columns}
    part = next(c for c in (f"_slice{i}" for i in range(len(taken) + 1)) if c not in taken)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = _stored(df.repartitionByRange(slices, key, *order).withColumn(part, F.spark_partition_id()), "slices")
    # Only a group at a border lies in several slices: at most two rows per slice are left.
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(key, part)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier))
        .where(F.col("_before").isNotNull())
        .select(F.col(key).alias("_key"), F.col(part).alias("_part"), "_before")
    )
    place = F.row_number().over(Window.partitionBy(key, part).orderBy(*order)).cast("bigint")
    return (
        sliced.withColumn(name, place)
        .join(F.broadcast(before), (F.col(key) == F.col("_key")) & (F.col(part) == F.col("_part")), "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    with storing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
