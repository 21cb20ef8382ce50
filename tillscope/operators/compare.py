"""Comparison of two results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both results side by side per key, with ``difference`` and PASS/FAIL per value.

    A key that only one side has fails; null keys of both sides are equal.  The result is
    long: one row per key and value.
    """
    keys = list(keys)
    left = expected.select(*keys, F.lit(True).alias("_e"), *(F.col(v).alias(f"_e_{v}") for v in values))
    right = actual.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.lit(True).alias("_a"), *(F.col(v).alias(f"_a_{v}") for v in values)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    pairs = F.array(
        *(
            F.struct(
                F.lit(v).alias("value_name"),
                F.col(f"_e_{v}").cast("double").alias("expected"),
                F.col(f"_a_{v}").cast("double").alias("actual"),
                F.col(f"_e_{v}").eqNullSafe(F.col(f"_a_{v}")).alias("equal"),
            )
            for v in values
        )
    )
    passed = F.col("_e").isNotNull() & F.col("_a").isNotNull() & F.col("pair.equal")
    return (
        left.join(right, same, "full_outer")
        .withColumn("pair", F.explode(pairs))
        .select(
            *(F.coalesce(k, f"_k_{k}").alias(k) for k in keys),
            "pair.value_name",
            "pair.expected",
            "pair.actual",
            (F.col("pair.actual") - F.col("pair.expected")).alias("difference"),
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        )
    )


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every different row of both sides, with how often each side has it.

    One grouping of both sides together: rows are counted in each task before the only
    shuffle.  Columns belong together by position; null cells are equal.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = left.select("*", one.alias("_left"), none.alias("_right")).union(
        right.select("*", none.alias("_left"), one.alias("_right"))
    )
    return sides.groupBy(*left.columns).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def key_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, each marked with that side; empty when the sets are equal."""
    side = F.when(F.col("_right") == 0, "left").when(F.col("_left") == 0, "right")
    return _counted(left, right).select(*left.columns, side.alias("side")).where("side IS NOT NULL")


def key_multiset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with that side and the surplus; empty when the multisets are equal."""
    more = F.col("_left") - F.col("_right")
    side = F.when(more > 0, "left").when(more < 0, "right")
    return _counted(left, right).where(more != 0).select(*left.columns, side.alias("side"), F.abs(more).alias("surplus"))


def common_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """The different rows that both sides have."""
    return _counted(left, right).where("_left > 0 AND _right > 0").select(*left.columns)


def verdict(checks: DataFrame) -> DataFrame:
    """One row: PASS only if every check passed."""
    failed = F.count(F.when(F.col("status") != "PASS", 1))
    return checks.agg(
        F.count("*").alias("checks"),
        failed.alias("failed"),
        F.when(failed == 0, "PASS").otherwise("FAIL").alias("verdict"),
    )
