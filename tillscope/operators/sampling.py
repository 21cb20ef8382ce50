"""Whole-basket sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the draw that form a bucket: 65,536 buckets per stratum.
_BUCKET_DIGITS = 4


def sample_baskets(
    df: DataFrame,
    fraction: float,
    seed: int,
    *,
    stratum: str = "date",
    basket: str = "transaction_id",
) -> DataFrame:
    """Keep all rows of a random ``fraction`` of the baskets of every day.

    Each day keeps ``max(1, round_half_even(baskets * fraction))`` baskets, never
    part of one.  A basket seen on two days stays whole if either day draws it;
    rows without a day draw nothing.

    The draw orders baskets by a hash of id and seed, so it does not depend on
    partitioning.  No task ever ranks a whole day: counts per hash bucket tell
    which buckets are in, and only baskets of one bucket are ranked together.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must lie between 0 and 1, not {fraction}")
    drawn = drawn_baskets(df, fraction, seed, stratum=stratum, basket=basket)
    return df.join(drawn.select(basket), basket, "left_semi")


def drawn_baskets(
    df: DataFrame, fraction: float, seed: int, *, stratum: str = "date", basket: str = "transaction_id"
) -> DataFrame:
    """The (stratum, basket) pairs that the draw keeps."""
    # Never null, and declared so: otherwise the join on the bucket would test the
    # hash of every line before the lines are reduced to baskets.
    draw = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(basket)).cast("binary")), F.lit(""))
    baskets = (
        df.where(F.col(stratum).isNotNull() & F.col(basket).isNotNull())
        .select(stratum, basket)
        .distinct()
        .withColumn("_draw", draw)
        .withColumn("_bucket", F.substring("_draw", 1, _BUCKET_DIGITS))
    )
    # One row per (stratum, bucket): at most 65,536 rows per stratum in the windows below.
    counts = baskets.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(stratum)
    so_far = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_baskets = F.sum("_n").over(whole)
    wanted = F.least(all_baskets, F.greatest(F.lit(1), F.bround(all_baskets * F.lit(float(fraction))).cast("bigint")))
    allowed = (
        counts.withColumn("_allowed", wanted - F.sum("_n").over(so_far) + F.col("_n"))
        .where(F.col("_allowed") > 0)
        .select(stratum, "_bucket", "_allowed")
    )
    rank = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_draw", basket))
    return (
        baskets.join(allowed, [stratum, "_bucket"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_allowed"))
        .select(stratum, basket)
    )
