import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillscope.names import LINE_ITEM_COLUMNS
from tillscope.operators.numbering import number_rows
from tillscope.plans.tables import build_daily_item_sales, build_line_items, build_tables, build_transactions
from tillscope.session import STORING
from tillscope.sources import order_lines
from tillscope.sources.tables import FOOTERS, _conf, _number_files, build_and_load, save_tables, store_together, stored_date_bounds

SCHEMA = """n int, transaction_id string, transaction_ts timestamp_ntz, date date, sku string, item string,
            category string, qty double, gross_sales decimal(18,2), discounts decimal(18,2), net_sales decimal(18,2),
            tax decimal(18,2), payment_id string, device_name string"""


def cleaned(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def line(n, basket, sku="s", qty=1.0, day=1, hour=9, discount=None, item="i", category="c", payment=None, device=None):
    ts = dt.datetime(2025, 1, day, hour)
    price = Decimal(n)
    return (n, basket, ts, ts.date(), sku, item, category, qty, price, discount, price, Decimal(0), payment, device)


def test_line_items_are_numbered_in_row_order(spark):
    rows = [line(1, "B"), line(2, "A"), line(3, "B", discount=Decimal("-0.5")), line(4, "B"), line(5, None)]
    items = build_line_items(cleaned(spark, rows), ["n"])
    assert items.columns == [c for c in LINE_ITEM_COLUMNS if c != "price_point_name"]
    got = {(r.line_item_id, int(r.gross_sales), r.discounts) for r in items.collect()}
    zero = Decimal("0.00")
    assert got == {("B-1", 1, zero), ("A-1", 2, zero), ("B-2", 3, Decimal("-0.50")), ("B-3", 4, zero), (None, 5, zero)}
    assert dict(items.dtypes)["qty"] == "bigint"


def test_absent_discounts_count_as_zero(spark):
    items = build_line_items(cleaned(spark, [line(1, "A")]).drop("discounts"), ["n"])
    assert items.first().discounts == 0


def test_order_is_required(spark):
    with pytest.raises(ValueError, match="source_row"):
        build_line_items(cleaned(spark, [line(1, "A")]))


@pytest.mark.parametrize("hot", [10, 500, 10**6])
def test_groups_of_any_size_are_numbered_in_slices(spark, hot):
    """A basket with most of the rows lies in several slices and is numbered like the small ones."""
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 <> 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS k",
        "(id * 7919) % 3000 AS a",
        "id AS b",
    )
    numbered = number_rows(rows.repartition(6), "k", ["a", "b"], "n", hot)
    expected = {}
    for k, a, b in sorted(((r.k, r.a, r.b) for r in rows.collect()), key=lambda r: r[1:]):
        expected.setdefault(k, []).append((a, b))
    got = {(r.k, r.n, r.a, r.b) for r in numbered.collect()}
    want = {(k, i, a, b) for k, v in expected.items() if k is not None for i, (a, b) in enumerate(v, 1)}
    want |= {(None, None, a, b) for a, b in expected[None]}
    assert numbered.columns == ["k", "a", "b", "n"]
    assert got == want


def test_baskets_take_the_first_value_that_is_there(spark):
    rows = [
        line(1, "A", hour=9, qty=2.0, payment=None, device="d1"),
        line(2, "A", hour=10, qty=3.0, payment="p2", device="d2"),
        line(3, "B", day=4, hour=23),
        line(4, None, hour=8),
    ]
    baskets = {r.transaction_id: r for r in build_transactions(cleaned(spark, rows), ["n"]).collect()}
    assert set(baskets) == {"A", "B"}
    a, b = baskets["A"], baskets["B"]
    assert (a.num_line_items, a.total_qty, a.total_gross_sales, a.payment_id, a.device_name) == (2, 5, 3, "p2", "d1")
    assert (a.hour, a.weekday, a.date) == (9, "Wednesday", dt.date(2025, 1, 1))
    assert (b.payment_id, b.hour, b.weekday, b.total_discounts) == (None, 23, "Saturday", 0)


def test_basket_columns_follow_the_source(spark):
    baskets = build_transactions(cleaned(spark, [line(1, "A")]).drop("payment_id"), ["n"])
    assert "payment_id" not in baskets.columns and "device_name" in baskets.columns


def test_daily_rollup(spark):
    rows = [
        line(1, "A", "x", 2.0, item=None), line(2, "A", "x", 1.0, item="second"), line(3, "B", "x", 1.0, item="third"),
        line(4, "B", "y"), line(5, "C", "x", day=2), line(6, "C", None),
    ]
    daily = {(r.date.day, r.sku): r for r in build_daily_item_sales(cleaned(spark, rows), ["n"]).collect()}
    assert set(daily) == {(1, "x"), (1, "y"), (2, "x")}
    x = daily[(1, "x")]
    assert (x.item, x.units_sold, x.gross_sales, x.transactions_count) == ("second", 4, 6, 2)


def test_sums_of_nothing_are_zero(spark):
    rows = [line(1, "A")[:8] + (None, None, None, None, None, None)]
    basket = build_transactions(cleaned(spark, rows), ["n"]).first()
    assert (basket.total_gross_sales, basket.total_net_sales, basket.total_tax) == (0, 0, 0)


def test_tables_agree_with_each_other(spark, folder):
    lines = order_lines.sales_lines(spark, folder)
    tables = build_tables(lines, order_lines.LINE_ORDER)
    assert set(tables) == {"transactions", "line_items", "daily_item_sales"}
    items, baskets, daily = tables["line_items"], tables["transactions"], tables["daily_item_sales"]
    assert items.count() == lines.count()
    assert items.select("line_item_id").distinct().count() == items.count()
    assert baskets.where("num_line_items <= 0").isEmpty()
    per_basket = items.groupBy("transaction_id").agg(F.sum("gross_sales").alias("g"))
    assert baskets.join(per_basket, "transaction_id").where("g <> total_gross_sales").isEmpty()
    assert daily.agg(F.sum("units_sold")).first() == items.agg(F.sum("qty")).first()


def test_aggregates_shrink_before_they_shuffle(spark, folder):
    """Baskets and rollup aggregate on both sides of their exchange, so one hot key cannot fill a task."""
    lines = order_lines.sales_lines(spark, folder)
    for df in (build_transactions(lines, order_lines.LINE_ORDER), build_daily_item_sales(lines, order_lines.LINE_ORDER)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan and "Window" not in plan


def test_files_are_numbered_in_the_order_of_their_paths(spark, tmp_path):
    rows = [("b", 7), ("a", 9), (None, 1), ("b", 2)]
    numbered = _number_files(spark.createDataFrame(rows, "source_file string, source_row bigint"), f"{tmp_path}/files")
    got = {(r.source_file, r.source_row, r.file_no) for r in numbered.collect()}
    assert got == {("b", 7, 2), ("a", 9, 1), (None, 1, None), ("b", 2, 2)}


def test_loaded_tables_are_those_of_the_paths_order(spark, tmp_path):
    """Numbered files and stored rows give the tables that lazy building gives, also for patchy baskets."""
    plain = [
        line(1, "A", device="d1"), line(2, "A", payment="p2"), line(3, "A", payment="p3", device="d3"), line(4, "A", "t"),
        line(5, "B", item=None), line(6, "B", category=None, item="late"), line(7, "C", payment="p7", device="d7"),
        line(8, None), line(9, None), line(10, "A", day=2), line(11, "B", "u", item=None),
    ]
    rows = cleaned(spark, plain).withColumn("source_file", F.when(F.col("n") % 3 != 0, F.concat(F.lit("f"), 9 - F.col("n") % 3)))
    rows = rows.withColumn("source_row", F.col("n").cast("bigint")).drop("n")
    loaded = build_and_load(rows, folder=str(tmp_path), check=False)
    position = F.struct("source_file", "source_row")
    assert loaded.keys() == build_tables(rows).keys()
    for name, table in build_tables(rows.withColumn("place", position), ["place"]).items():
        assert loaded[name].dtypes == table.dtypes
        assert sorted(map(str, loaded[name].collect())) == sorted(map(str, table.collect()))


def test_values_of_stored_rows_are_shuffled_once(spark):
    """By day and sku; the grouping by basket shuffles its keys and a count only."""
    rows = [line(1, "A", "x"), line(2, "A", "x"), line(3, "B", "x"), line(4, None, "x"), line(5, None, "y"), line(6, "B", None)]
    lines = cleaned(spark, rows)
    daily = build_daily_item_sales(lines, ["n"], stored=True)
    assert {(r.sku, r.units_sold, r.transactions_count) for r in daily.collect()} == {("x", 4, 2), ("y", 1, 0)}
    assert daily.schema == build_daily_item_sales(lines, ["n"]).schema
    plan = daily._jdf.queryExecution().optimizedPlan().toString()
    assert not [node for node in plan.splitlines() if "transaction_id" in node and "sum(gross_sales" in node]


def test_bounds_come_from_footers(spark, tmp_path):
    rows = [(dt.date(2025, 1, 3), 1), (dt.date(2024, 12, 30), 2), (None, 3), (dt.date(2025, 3, 1), 4)]
    lines = spark.createDataFrame(rows, "date date, n int")
    lines.coalesce(1).write.parquet(f"{tmp_path}/some")
    lines.repartition(4, "n").write.partitionBy("n").parquet(f"{tmp_path}/apart")
    lines.limit(0).write.parquet(f"{tmp_path}/none")
    before = {key: spark.conf.get(key, None) for key in FOOTERS}
    for name in ("some", "apart"):
        # One folder of "apart" holds nulls only.
        assert tuple(stored_date_bounds(spark, f"{tmp_path}/{name}").first()) == (dt.date(2024, 12, 30), dt.date(2025, 3, 1))
    today = spark.range(1).select(F.current_date()).first()[0]
    assert tuple(stored_date_bounds(spark, f"{tmp_path}/none").first()) == (today, today)
    assert {key: spark.conf.get(key, None) for key in FOOTERS} == before
    with _conf(spark, FOOTERS):
        plan = spark.read.parquet(f"{tmp_path}/some").agg(F.min("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(date)]" in plan


def shuffle_files(spark):
    """Names of the shuffle files that are on disk."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name and name.endswith(".data")}


@pytest.mark.parametrize("together", [False, True])
def test_loads_leave_only_their_tables_on_disk(spark, tmp_path, together):
    """The shuffles of each step go with it; settings of the session stay as they were."""
    rows = cleaned(spark, [line(n, f"B{n % 7}", f"s{n % 3}", day=1 + n % 5) for n in range(60)])
    before, settings = shuffle_files(spark), {key: spark.conf.get(key) for key in STORING}
    build_and_load(rows, ["n"], folder=str(tmp_path), by_month=True, together=together)
    # The list of loads is sorted when the tables are opened: one row.
    assert len(shuffle_files(spark) - before) <= 1
    assert {key: spark.conf.get(key) for key in STORING} == settings
    assert list(tmp_path.glob("load-*/daily_item_sales/sale_month=*/*.zstd.parquet"))


def test_rows_kept_together_are_not_shuffled_by_basket_again(spark, tmp_path):
    plain = [line(n, f"B{n % 7}" if n % 11 else None, f"s{n % 3}", payment=f"p{n}" if n % 2 else None) for n in range(60)]
    rows = cleaned(spark, plain)
    kept = store_together(rows, f"{tmp_path}/rows")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert not [table.name for table in spark.catalog.listTables() if table.name.startswith("together_")]
    expected = build_tables(rows, ["n"], True)
    for name, table in build_tables(kept, ["n"], True).items():
        assert sorted(map(str, table.collect())) == sorted(map(str, expected[name].collect()))
        plan = table._jdf.queryExecution().executedPlan().toString()
        # The rollup is shuffled by day and sku, the other tables not at all.
        assert plan.split("== Initial Plan ==")[-1].count("Exchange") == (name == "daily_item_sales")


def test_repeated_baskets_are_counted_before_the_values_are_shuffled(spark):
    """One shuffle of the rollup of stored rows is left when it is worked out, that of the values."""
    rows = [line(1, "A", "x"), line(2, "A", "x"), line(3, "B", "x"), line(4, None, "x"), line(5, "A", "y")]
    daily = build_daily_item_sales(cleaned(spark, rows).coalesce(1), ["n"], True)
    plan = daily._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.sku, r.transactions_count) for r in daily.collect()} == {("x", 2), ("y", 1)}


def test_rows_of_equal_place_give_values_of_one_row(spark):
    """Also in orders that do not tell all rows apart."""
    rows = [line(1, "A", "x", item="b", category="d", payment="p2", device="d1"), line(1, "A", "x", payment="p1", device="d2")]
    basket = build_transactions(cleaned(spark, rows), ["n"]).first()
    assert (basket.payment_id, basket.device_name) == ("p1", "d2")
    for stored in (False, True):
        day = build_daily_item_sales(cleaned(spark, rows), ["n"], stored).first()
        assert (day.item, day.category, day.transactions_count) == ("b", "d", 1)


def test_columns_that_follow_from_others_are_worked_out_after_the_layout(spark, folder, tmp_path):
    joined = order_lines.joined_lines(spark, folder)
    lines = order_lines.sales_lines(spark, folder)
    save_tables({"lines": joined}, str(tmp_path), by_month=True, finish=order_lines.sales_columns)
    stored = spark.read.parquet(f"{tmp_path}/lines")
    assert stored.where("sale_month <> trunc(date, 'MM')").isEmpty()
    stored = stored.drop("sale_month").select(*lines.columns)
    assert stored.exceptAll(lines).isEmpty() and lines.exceptAll(stored).isEmpty()
    assert len(joined.columns) < len(lines.columns) and "transaction_id" not in joined.columns
