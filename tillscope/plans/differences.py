"""Where two versions of a table differ, found by order-independent digests from the month down to the basket.

The digest of a group is its number of rows and the sum of their hashes, so it does
not depend on order or partitioning and shrinks in each task before it is shuffled.
Days are looked at only in months whose digests differ, baskets only on days that do;
over tables stored by month (with their month column), all other months' files stay
closed.

Null cells are values of their own, and rows without a day, or without a key, are
groups like any other.  Repeated rows count as often as they stand there.  Columns
belong together by name; both sides need the same ones.  Two groups of different rows
have equal digests with a chance of about 2 to the power of -64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.calendar import MONTH, month_start
from tillscope.session import scratch_path, storing


def row_digest(columns: list[str]) -> Column:
    # A hash skips nulls, so where they stand is hashed too.
    cells = [F.col(name) for name in columns]
    return F.xxhash64(*cells, *(cell.isNull() for cell in cells))


def _differing(left: DataFrame, right: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The groups of ``by`` whose digests differ, with the rows of each side."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        digest = row_digest(columns).cast("decimal(38,0)") * F.lit(sign)
        one = F.lit(1).cast("bigint")
        return df.select(*by, digest.cast("decimal(38,0)").alias("_digest"), *(
            (one if sign == own else F.lit(0).cast("bigint")).alias(name) for own, name in ((1, "left_rows"), (-1, "right_rows"))
        ))

    summed = side(left, 1).unionByName(side(right, -1)).groupBy(*by).agg(
        F.sum("_digest").alias("_digest"), F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")
    )
    return summed.where((F.col("_digest") != 0) | (F.col("left_rows") != F.col("right_rows"))).drop("_digest")


def _one_of(column: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = F.col(column).isin(known) if known else F.lit(False)
    return found | F.col(column).isNull() if None in values else found


def differing_months(left: DataFrame, right: DataFrame, day: str = "date") -> DataFrame:
    """Months whose rows differ: month, left_rows, right_rows."""
    columns = _columns(left, right)
    months = [df if MONTH in df.columns else df.withColumn(MONTH, month_start(F.col(day))) for df in (left, right)]
    return _differing(*months, columns, [MONTH]).withColumnRenamed(MONTH, "month")


def find_differences(left: DataFrame, right: DataFrame, key: str = "transaction_id", day: str = "date") -> DataFrame:
    """Days and keys whose rows differ: ``day``, ``key``, left_rows, right_rows."""
    columns = _columns(left, right)
    # At most one row per calendar month, and per day of those.
    months = [row["month"] for row in differing_months(left, right, day).select("month").collect()]
    if not months:
        return _differing(left.limit(0), right.limit(0), columns, [day, key])
    left, right = (
        df.where(_one_of(MONTH, months) if MONTH in df.columns else _within(day, months)) for df in (left, right)
    )
    path = scratch_path(left.sparkSession, "differing-days")
    with storing(left.sparkSession):
        _differing(left, right, columns, [day]).select(day).write.parquet(path)
    days = [row[0] for row in left.sparkSession.read.parquet(path).collect()]
    left, right = (df.where(_one_of(day, days)) for df in (left, right))
    return _differing(left, right, columns, [day, key])


def _within(day: str, months: list) -> Column:
    """A condition on the day itself, so that it reaches the scan."""
    found = F.lit(False)
    for month in months:
        if month is None:
            found = found | F.col(day).isNull()
        else:
            first = F.lit(month)
            found = found | ((F.col(day) >= first) & (F.col(day) < F.add_months(first, 1)))
    return found


def _columns(left: DataFrame, right: DataFrame) -> list[str]:
    own, other = ({name for name in df.columns if name != MONTH} for df in (left, right))
    if own != other:
        raise ValueError(f"columns differ: {sorted(own ^ other)}")
    return sorted(own)
