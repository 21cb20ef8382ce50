"""Differences by digests and KPIs from daily totals, on odd rows."""

import pytest
from pyspark.sql import functions as F

from tillscope.plans.day_totals import kpis_of_days, save_day_totals
from tillscope.plans.differences import differing_months, find_differences
from tillscope.plans.metrics import headline_kpis
from tillscope.sources.tables import save_tables

ROWS = [
    ("a", "2020-01-05", "s", "x", 1, "1.00"), ("a", "2020-01-05", "s", "x", 1, "1.00"), ("b", "2020-01-05", "s", None, None, None),
    ("b", "2020-02-01", "t", "y", 2, "2.50"), ("c", "2020-02-29", "t", "x", 3, "0.00"), ("d", None, "u", "z", 4, "4.00"),
    (None, "2020-03-01", "u", "w", 5, "5.00"), ("a", "2020-03-31", "u", "w", 6, "6.00"),
]


def parts(rows):
    return [(*row[:2], row[2], row[3], "c", *row[4:]) for row in rows]


@pytest.fixture
def lines(lines_of):
    return lines_of(parts(ROWS))


def found(df):
    return {(r.transaction_id, str(r.date), r.left_rows, r.right_rows) for r in df.collect()}


def test_differences_are_found_basket_by_basket(lines, lines_of):
    assert find_differences(lines, lines.repartition(3)).isEmpty()
    other = list(ROWS)
    other[1] = ("a", "2020-01-05", "s", "x", 1, "1.01")
    other[2] = ("b", "2020-01-05", "s", None, 0, None)
    other[4] = ("c", "2020-02-28", "t", "x", 3, "0.00")
    del other[5]
    other[5] = (None, "2020-03-01", "u", "w", 5, None)
    other = lines_of(parts(other))
    assert found(find_differences(lines, other)) == {
        ("a", "2020-01-05", 2, 2), ("b", "2020-01-05", 1, 1), ("c", "2020-02-29", 1, 0), ("c", "2020-02-28", 0, 1),
        ("d", "None", 1, 0), (None, "2020-03-01", 1, 1),
    }
    assert found(find_differences(lines, lines.limit(0))) == {
        (k, d, n, 0) for k, d, n in {(r[0], str(r[1]), sum(q[:2] == r[:2] for q in ROWS)) for r in ROWS}
    }
    assert find_differences(lines.limit(0), lines.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="net_sales"):
        find_differences(lines, lines.drop("net_sales"))


def test_repeated_rows_and_moved_nulls_differ(spark):
    schema = "transaction_id string, date date, x int, y int"
    day = spark.sql("SELECT DATE '2020-01-01'").first()[0]
    left = spark.createDataFrame([("a", day, None, 1), ("b", day, 2, 2), ("b", day, 2, 2)], schema)
    right = spark.createDataFrame([("a", day, 1, None), ("b", day, 2, 2)], schema)
    assert found(find_differences(left, right)) == {("a", "2020-01-01", 1, 1), ("b", "2020-01-01", 2, 1)}


def test_only_months_that_differ_are_read(spark, lines, tmp_path):
    other = lines.withColumn("qty", F.when(F.col("transaction_id") == "c", 9).otherwise(F.col("qty")))
    save_tables({"own": lines, "other": other}, str(tmp_path), by_month=True)
    own, other = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("own", "other"))
    assert [str(r.month) for r in differing_months(own, other).collect()] == ["2020-02-01"]
    result = find_differences(own, other)
    assert found(result) == {("c", "2020-02-29", 1, 1)}
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(sale_month" in plan or "PartitionFilters: [isnotnull(sale_month" in plan


@pytest.mark.parametrize("days", [("2020-01-01", "2020-12-31"), ("2020-01-05", "2020-01-05"), ("2020-02-01", "2020-03-30"), ("1999-01-01", "1999-01-01")])
def test_kpis_from_daily_totals(spark, lines, tmp_path, days):
    save_day_totals(lines, str(tmp_path))
    assert kpis_of_days(spark, str(tmp_path), *days).collect() == headline_kpis(lines, *days).collect()
    save_day_totals(lines.limit(0), f"{tmp_path}/empty")
    assert [tuple(map(float, r)) for r in kpis_of_days(spark, f"{tmp_path}/empty", *days).collect()] == [(0.0,) * 5]


def test_sets_of_more_names_than_a_bucket_holds(spark, tmp_path):
    many = spark.range(100_000).selectExpr(
        "concat('b', id) AS transaction_id", "date_add(DATE '2020-01-01', cast(id % 3 AS int)) AS date",
        "concat('i', id % 40000) AS item", "cast(1 AS bigint) AS qty", "cast(1 AS decimal(18,2)) AS net_sales",
    )
    save_day_totals(many, str(tmp_path))
    for days in (("2020-01-01", "2020-01-03"), ("2020-01-02", "2020-01-03"), ("2020-01-03", "2020-01-03")):
        assert kpis_of_days(spark, str(tmp_path), *days).collect() == headline_kpis(many, *days).collect()
