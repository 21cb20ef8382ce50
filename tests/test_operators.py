import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillscope.operators import compare, stockouts
from tillscope.operators.sampling import drawn_baskets, sample_baskets
from tillscope.plans import reconcile
from tillscope.sources import order_lines


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def windows(spark):
    return spark.createDataFrame(
        [("BEV-001", day(10), day(20)), ("BEV-001", day(18), day(25)), ("SNK-001", day(5), day(5)), ("DRY-001", day(9), day(8))],
        "sku string, start_date date, end_date date",
    )


@pytest.fixture
def daily(spark):
    rows = [("BEV-001", 5), ("BEV-001", 10), ("BEV-001", 20), ("BEV-001", 26), ("SNK-001", 5), ("SNK-002", 15), (None, 15)]
    return spark.createDataFrame([(s, day(n)) for s, n in rows], "sku string, date date")


def test_out_of_stock(daily, windows):
    flagged = stockouts.flag_out_of_stock(daily, windows)
    got = sorted((r.sku or "", (r.date - day(0)).days, r.out_of_stock) for r in flagged.collect())
    assert got == [
        ("", 15, False), ("BEV-001", 5, False), ("BEV-001", 10, True), ("BEV-001", 20, True), ("BEV-001", 26, False),
        ("SNK-001", 5, True), ("SNK-002", 15, False),
    ]


def test_sale_days_keep_quiet_windows(daily, windows):
    rows = stockouts.sale_days_in_windows(daily, windows).collect()
    got = {(r.sku, (r.start_date - day(0)).days): (r.window_days, r.sale_days) for r in rows}
    assert got == {("BEV-001", 10): (11, 2), ("BEV-001", 18): (8, 1), ("SNK-001", 5): (1, 1), ("DRY-001", 9): (0, 0)}


def test_inside_and_outside_split_the_sales(daily, windows):
    inside = stockouts.sales_inside_windows(daily, windows)
    outside = stockouts.sales_outside_windows(daily, windows)
    assert sorted((r.sku, (r.date - day(0)).days) for r in inside.collect()) == [("BEV-001", 10), ("BEV-001", 20), ("SNK-001", 5)]
    assert inside.count() + outside.count() == daily.count()


def test_window_days(windows):
    rows = stockouts.window_days(windows).groupBy("sku", "start_date").agg(F.count("date").alias("n")).collect()
    assert sorted(r.n for r in rows) == [0, 1, 8, 11]


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
def test_sample_sizes_per_day(spark, fraction):
    sizes = {1: 1, 2: 5, 3: 25, 4: 400}
    rows = [(day(d), f"T{d}-{i}", k) for d, n in sizes.items() for i in range(n) for k in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "date date, transaction_id string, k int").repartition(4)
    sample = sample_baskets(df, fraction, seed=3)
    kept = defaultdict(set)
    for r in sample.collect():
        kept[(r.date - day(0)).days].add(r.transaction_id)
    assert {d: len(ids) for d, ids in kept.items()} == {d: min(n, max(1, round(n * fraction))) for d, n in sizes.items()}
    assert reconcile.whole_baskets(df, sample).isEmpty()


def test_sample_does_not_depend_on_partitions_but_on_the_seed(spark):
    df = spark.range(3000).selectExpr("date_add(DATE '2025-01-01', cast(id % 3 as int)) AS date", "concat('T', id) AS transaction_id")
    one = {r[0] for r in sample_baskets(df.repartition(2), 0.2, 1).select("transaction_id").collect()}
    two = {r[0] for r in sample_baskets(df.repartition(9), 0.2, 1).select("transaction_id").collect()}
    other = {r[0] for r in sample_baskets(df, 0.2, 2).select("transaction_id").collect()}
    assert one == two and len(one) == 600 and one != other


def test_sample_equals_brute_force(spark):
    import hashlib

    rows = [(day(random.Random(i).randrange(4)), f"T{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "date date, transaction_id string")
    got = {tuple(r) for r in drawn_baskets(df, 0.37, 9).collect()}
    by_day = defaultdict(list)
    for d, t in rows:
        by_day[d].append((hashlib.md5(f"9:{t}".encode()).hexdigest(), t))
    want = {(d, t) for d, ids in by_day.items() for _, t in sorted(ids)[: max(1, round(len(ids) * 0.37))]}
    assert got == want


def test_basket_on_two_days_stays_whole_and_undated_rows_draw_nothing(spark):
    rows = [(day(1), "A"), (day(2), "A"), (day(2), "A"), (None, "B")]
    df = spark.createDataFrame(rows, "date date, transaction_id string")
    assert [r.transaction_id for r in sample_baskets(df, 0.5, 1).collect()] == ["A"] * 3


def test_align_marks_missing_keys(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "k int, v int")
    right = spark.createDataFrame([(1, 10), (2, 21), (3, None), (4, 1)], "k int, v int")
    rows = {r.k: (r.difference, r.status) for r in compare.align(left, right, ["k"], ["v"]).collect()}
    assert rows == {1: (0.0, "PASS"), 2: (1.0, "FAIL"), 3: (None, "PASS"), 4: (None, "FAIL")}


def test_key_sets(spark):
    left, right = spark.range(5), spark.range(3, 8)
    assert {(r.id, r.side) for r in compare.key_differences(left, right).collect()} == {
        (0, "left"), (1, "left"), (2, "left"), (5, "right"), (6, "right"), (7, "right"),
    }
    assert {r.id for r in compare.common_keys(left, right).collect()} == {3, 4}
    assert compare.key_differences(left, left).isEmpty()


def test_check_ranges(spark):
    bounds = spark.sql("SELECT DATE '2025-01-01' AS min_date, DATE '2025-12-31' AS max_date")
    rows = [tuple(r) for r in reconcile.check_ranges(bounds).collect()]
    assert rows == [
        (reconcile.FULL, dt.date(2025, 1, 1), dt.date(2025, 12, 31)),
        (reconcile.MIDDLE, dt.date(2025, 5, 2), dt.date(2025, 8, 31)),
    ]


def test_reconciliation_passes_and_notices_a_cent(spark, folder):
    raw = order_lines.raw_export(spark, folder)
    lines = order_lines.sales_lines(spark, folder)
    rows = reconcile.reconcile_kpis(raw, lines)
    assert rows.count() == 10
    assert compare.verdict(rows).first().verdict == "PASS"
    one = lines.agg(F.min("date")).first()[0]
    cent = F.when(F.col("date") == one, F.lit("0.01")).otherwise("0").cast("decimal(18,2)")
    off = lines.withColumn("net_sales", F.col("net_sales") + cent)
    bad = {(r.kpi, r.date_range.split(":")[0]) for r in reconcile.reconcile_kpis(raw, off).where("status = 'FAIL'").collect()}
    assert ("Net Sales", reconcile.FULL) in bad and all(label == reconcile.FULL for _, label in bad)


def test_raw_money_in_cents(spark):
    from tillscope.functions.numbers import cents_from_text

    df = spark.createDataFrame([("$12.98", 1298), ("-$1.50", -150), (" $1,234.50 ", 123450), ("$0.00", 0)], "t string, c bigint")
    assert df.where(cents_from_text(F.col("t")) != F.col("c")).isEmpty()


def test_grains_of_wrong_tables_differ(spark, folder):
    from tillscope.plans.tables import build_daily_item_sales, build_line_items, build_transactions

    order = order_lines.LINE_ORDER
    lines = order_lines.sales_lines(spark, folder)
    items, baskets, daily = build_line_items(lines, order), build_transactions(lines, order), build_daily_item_sales(lines, order)
    assert set(reconcile.grain_checks(items, baskets, daily).first()) == {0}
    assert reconcile.grain_checks(items, baskets.limit(5), daily).first().line_count_diff > 0


@pytest.fixture
def tight(spark):
    """Thresholds at which a few thousand rows of one key count as skewed, and no broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_hot_keys_are_split_over_tasks(spark, windows, tight):
    """Half of all rows share one sku, day and basket."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "IF(id % 2 = 0, 'BEV-001', concat('P-', id % 5000)) AS sku",
        "date_add(DATE '2025-01-01', IF(id % 2 = 0, 12, cast(id % 60 as int))) AS date",
        "IF(id % 2 = 0, 'HOT', concat('T', id)) AS transaction_id",
        "md5(cast(id as string)) AS payload",
    )
    joins = {
        "flag": stockouts.flag_out_of_stock(rows, windows).where("out_of_stock"),
        "inside": stockouts.sales_inside_windows(rows, windows),
        "sample": sample_baskets(rows, 1.0, 1),
    }
    for name, joined in joins.items():
        # The payload keeps the rows as wide as real ones; its lengths count the rows.
        result = joined.agg(F.sum(F.length("payload")) / 32, F.max("payload"))
        assert result.collect()[0][0] == (200_000 if name == "sample" else 100_000), name
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString(), name


def test_equal_and_touching_windows_count_once(spark):
    days = "cast(a as date) as start_date, cast(b as date) as end_date"
    rows = [("x", "2025-01-01", "2025-01-05")] * 2 + [("x", "2025-01-04", "2025-01-08"), ("x", "2025-01-09", "2025-01-10")]
    rows += [("x", "2025-02-02", "2025-02-01"), ("y", "2025-01-01", "2025-01-01")]
    windows = spark.createDataFrame(rows, "sku string, a string, b string").selectExpr("sku", days.split(", ")[0], days.split(", ")[1])
    sales = spark.createDataFrame([("x", "2025-01-05"), ("x", "2025-01-11"), ("y", "2025-01-02")], "sku string, d string")
    sales = sales.selectExpr("sku", "cast(d as date) as date")
    counted = {(r.sku, str(r.start_date)): (r.window_days, r.sale_days) for r in stockouts.sale_days_in_windows(sales, windows).collect()}
    assert counted == {
        ("x", "2025-01-01"): (5, 1), ("x", "2025-01-04"): (5, 1), ("x", "2025-01-09"): (2, 0),
        ("x", "2025-02-02"): (0, 0), ("y", "2025-01-01"): (1, 0),
    }
    merged = {(r.sku, str(r.start_date), str(r.end_date)) for r in stockouts.merged_windows(windows).collect()}
    assert merged == {("x", "2025-01-01", "2025-01-10"), ("y", "2025-01-01", "2025-01-01")}
    flagged = stockouts.flag_out_of_stock(sales, windows)
    assert sorted((r.sku, str(r.date), r.out_of_stock) for r in flagged.collect()) == [
        ("x", "2025-01-05", True), ("x", "2025-01-11", False), ("y", "2025-01-02", False),
    ]


def test_multiset_differences_count_repeated_rows(spark):
    schema = "k string, v int"
    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 2), (None, 2), ("b", None), ("c", 3)], schema)
    right = spark.createDataFrame([("a", 1), (None, 2), (None, 2), (None, 2), ("b", None), ("d", 4)], "x string, y int")
    found = {tuple(r) for r in compare.key_multiset_differences(left, right).collect()}
    assert found == {("a", 1, "left", 2), (None, 2, "right", 1), ("c", 3, "left", 1), ("d", 4, "right", 1)}
    assert compare.key_multiset_differences(left, left).isEmpty()
    assert compare.key_multiset_differences(left.limit(0), right.limit(0)).isEmpty()
    plan = compare.key_multiset_differences(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_null_keys_are_compared(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 1), ("a", 5), ("c", 3)], "k string, v int")
    found = {(r.k, r.expected, r.actual, r.status) for r in compare.align(left, right, ["k"], ["v"]).collect()}
    assert found == {(None, 1.0, 1.0, "PASS"), ("a", 2.0, 5.0, "FAIL"), ("b", 3.0, None, "FAIL"), ("c", None, 3.0, "FAIL")}


def test_many_windows_of_one_sku_meet_few_rows(spark):
    """A sale meets the windows of its week only."""
    rows = spark.range(1000).selectExpr("'s' AS sku", "date_add(DATE '2020-01-01', cast(id * 10 AS int)) AS start_date")
    windows = rows.selectExpr("sku", "start_date", "date_add(start_date, 4) AS end_date")
    odd = spark.sql("SELECT 's' AS sku, DATE '2020-01-05' AS start_date, DATE '2020-01-01' AS end_date")
    sales = spark.range(10_000).selectExpr("'s' AS sku", "date_add(DATE '2019-12-30', cast(id AS int)) AS date")
    counted = stockouts.sale_days_in_windows(sales, windows.unionByName(windows).unionByName(odd)).collect()
    assert len(counted) == 1001 and {(r.window_days, r.sale_days) for r in counted} == {(5, 5), (0, 0)} | {
        (r.window_days, r.sale_days) for r in counted if r.sale_days < 5
    }
    assert sum(r.sale_days for r in counted) == stockouts.sales_inside_windows(sales, windows).count()
    bins = stockouts.binned(windows)
    met = sales.join(bins, stockouts._bin(sales["date"]) == bins["_bin"]).count()
    assert met <= 3 * sales.count()
