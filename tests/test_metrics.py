import datetime as dt

import pytest

from tillscope.names import WEEKDAYS
from tillscope.plans import metrics, profile

DAY = dt.date(2025, 1, 1)


@pytest.fixture
def lines(lines_of):
    return lines_of(
        [
            ("A", "2025-01-01", "s1", "tea", "Beverages", 2, "4.00"),
            ("A", "2025-01-01", "s2", "chips", "Snacks", 1, "6.00"),
            ("B", "2025-01-31", "s3", "tea", "Beverages", 1, "10.00"),
            ("C", "2025-03-02", "s2", "chips", "Snacks", 5, "5.00"),
            ("D", "2025-07-04", "s4", "ice", None, 1, "0.00"),
        ]
    )


def test_kpis(lines):
    row = metrics.headline_kpis(lines, "2025-01-01", "2025-12-31").first()
    assert (row.net_sales, row.transactions, row.avg_basket, row.units, row.distinct_items) == (25, 4, 6.25, 10, 3)


def test_both_ends_of_the_range_count(lines):
    one = metrics.headline_kpis(lines, DAY, DAY).first()
    assert (one.net_sales, one.transactions, one.units) == (10, 1, 3)
    two = metrics.headline_kpis(lines, dt.datetime(2025, 1, 1, 13), dt.date(2025, 1, 31)).first()
    assert two.transactions == 2


def test_timestamps_late_on_the_last_day_count(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-31 23:59:59' AS date")
    assert metrics.between_dates(df, "2025-01-01", "2025-01-31").count() == 1


def test_empty_range_gives_zeros_or_nothing(lines, spark):
    before = dt.date(2024, 1, 1)
    assert tuple(metrics.headline_kpis(lines, before, before).first()) == (0, 0, 0.0, 0, 0)
    assert metrics.category_mix(lines, before, before).isEmpty()
    assert metrics.month_over_month(lines, before, before).isEmpty()
    baskets = spark.createDataFrame([], "date date, weekday string, hour int")
    grid = metrics.hour_weekday_counts(baskets, before, before).collect()
    assert len(grid) == 168 and all(r.transactions == 0 for r in grid)


def test_cards(lines):
    row = metrics.kpi_cards(metrics.headline_kpis(lines, "2025-01-01", "2025-12-31")).first()
    assert tuple(row) == ("$25.00", "4", "$6.25", "10", "3")


def test_category_mix(lines):
    rows = [tuple(r) for r in metrics.category_mix(lines, "2025-01-01", "2025-12-31").collect()]
    assert rows == [("Beverages", 14, 56.0), ("Snacks", 11, 44.0), (None, 0, 0.0)]
    up = [r.category for r in metrics.category_mix_ascending(lines, "2025-01-01", "2025-12-31").collect()]
    assert up == [None, "Snacks", "Beverages"]


def test_shares_are_null_when_nothing_was_earned(lines_of):
    rows = lines_of([("A", "2025-01-01", "s", "i", "c", 1, "0.00")])
    assert metrics.category_mix(rows, DAY, DAY).first().pct_of_total is None


def test_ties_fall_back_on_the_name(lines_of):
    rows = lines_of([("A", "2025-01-01", "s", name, name, 1, "2.00") for name in ("b", "c", "a")])
    assert [r.category for r in metrics.category_mix(rows, DAY, DAY).collect()] == ["a", "b", "c"]
    assert [r.item for r in metrics.top_items_by_units(rows, DAY, DAY, 2).collect()] == ["a", "b"]
    assert [r.item for r in metrics.top_items_by_sales(rows, DAY, DAY, 2).collect()] == ["a", "b"]


def test_month_change_skips_absent_months_and_zero(lines):
    rows = [tuple(r) for r in metrics.month_over_month(lines, "2025-01-01", "2025-12-31").collect()]
    assert rows == [(DAY, 20, None), (dt.date(2025, 3, 1), 5, -75.0), (dt.date(2025, 7, 1), 0, -100.0)]


def test_month_change_after_a_month_without_income_is_null(lines_of):
    rows = lines_of([("A", f"2025-0{m}-01", "s", "i", "c", 1, v) for m, v in ((1, "0.00"), (2, "5.00"))])
    assert [r.mom_pct_change for r in metrics.month_over_month(rows, DAY, "2025-12-31").collect()] == [None, None]


def test_grid_is_full_and_starts_on_monday(spark):
    baskets = spark.createDataFrame(
        [(DAY, "Sunday", 0), (DAY, "Sunday", 0), (DAY, "Monday", 23), (DAY, None, None)], "date date, weekday string, hour int"
    )
    grid = metrics.hour_weekday_counts(baskets, DAY, DAY).collect()
    assert [r.weekday for r in grid[::24]] == list(WEEKDAYS)
    assert [r.hour for r in grid[:24]] == list(range(24))
    filled = {(r.weekday, r.hour): r.transactions for r in grid if r.transactions}
    assert filled == {("Sunday", 0): 2, ("Monday", 23): 1}
    matrix = metrics.hour_weekday_matrix(metrics.hour_weekday_counts(baskets, DAY, DAY)).collect()
    assert [r.weekday for r in matrix] == list(WEEKDAYS)
    assert (matrix[6].h00, matrix[0].h23, sum(sum(r[1:]) for r in matrix)) == (2, 1, 3)


def test_date_bounds(lines, spark):
    assert tuple(metrics.date_bounds(lines).first()) == (DAY, dt.date(2025, 7, 4))
    today = spark.sql("SELECT current_date()").first()[0]
    assert tuple(metrics.date_bounds(lines.limit(0)).first()) == (today, today)


def test_top_skus(spark):
    daily = spark.createDataFrame([("b", "x", "c", 5), ("a", "x", "c", 5), ("c", "y", "d", 9)], "sku string, item string, category string, units_sold bigint")
    assert [tuple(r) for r in metrics.top_skus_by_units(daily, 2).collect()] == [("c", "y", 9), ("a", "x", 5)]
    assert {tuple(r) for r in metrics.units_by_category(daily).collect()} == {("c", 10), ("d", 9)}


def test_lifts(lines_of):
    days = {"2025-06-06": "9.00", "2025-06-07": "3.00", "2025-06-02": "2.00", "2025-05-05": "4.00"}
    rows = lines_of([("T", day, "s", "i", "Beverages", 1, net) for day, net in days.items()])
    assert tuple(profile.weekend_lift(rows).first()) == (6.0, 3.0)
    assert tuple(profile.month_opening_lift(rows).first()) == (2.0, 16 / 3)
    assert tuple(profile.category_summer_lift(rows).first()) == (14 / 3, 4.0)
    assert tuple(profile.category_summer_lift(rows, "Candy").first()) == (None, None)


def test_shares_are_rounded_to_one_decimal(lines):
    assert [tuple(r) for r in profile.category_share(lines).collect()] == [("Beverages", 56.0), ("Snacks", 44.0)]


def test_row_count_tolerance(spark):
    assert tuple(profile.row_count_check(spark.range(95), 100).first()) == (95, True)
    assert tuple(profile.row_count_check(spark.range(89), 100).first()) == (89, False)


def test_range_filter_reaches_the_scan(spark, folder, tmp_path):
    from tillscope.sources import order_lines

    order_lines.sales_lines(spark, folder).write.parquet(str(tmp_path / "lines"))
    stored = spark.read.parquet(str(tmp_path / "lines"))
    plan = metrics.category_mix(stored, "1996-01-01", "1996-12-31")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1996-01-01), LessThan(date,1997-01-01)" in plan
    assert "ReadSchema: struct<date:date,category:string,net_sales:decimal(18,2)>" in plan


def test_mix_total_reuses_the_grouped_shuffle(spark, folder):
    from tillscope.sources import order_lines

    mix = metrics.category_mix(order_lines.sales_lines(spark, folder), "1995-01-01", "2001-12-31")
    mix.collect()
    plan = mix._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Window" not in plan
