from pathlib import Path

import pytest

from tillscope.catalog import queries
from tillscope.functions.calendar import between_dates
from tillscope.names import PRIVATE_COLUMNS, RAW_COLUMNS
from tillscope.operators.cleaning import clean
from tillscope.sources import order_lines, sales_csv
from tillscope.sources.sales_csv import ingest_csv, read_sales_csv, write_sales_csv
from tillscope.sources.tables import build_and_load, load_views, open_tables, query_table, save_tables
from tillscope.operators.contract import ContractError

HEADER = ",".join(RAW_COLUMNS)


def sales_row(day="01/15/2025", basket="SQ1", qty="1", **cells):
    values = {name: "" for name in RAW_COLUMNS} | {
        "Date": day, "Time": "02:30:00 PM", "Category": "Snacks", "Item": "Chips", "SKU": "SNK-001", "Qty": qty,
        "Gross Sales": "$2.00", "Discounts": "$0.00", "Net Sales": "$2.00", "Tax": "$0.14",
        "Transaction ID": basket, "Customer Name": "Jane",
    } | cells
    return ",".join(values[name] for name in RAW_COLUMNS)


def test_every_cell_is_text_and_only_empty_is_null(spark, export):
    path = export('A,B,"C d"\n1,"",N/A\n,"x ""q"" y", z \nnan,NULL,007\n')
    rows = read_sales_csv(spark, path, keep_order=False)
    assert rows.dtypes == [("A", "string"), ("B", "string"), ("C d", "string")]
    assert [tuple(r) for r in rows.collect()] == [
        ("1", None, "N/A"),
        (None, 'x "q" y', " z "),
        ("nan", "NULL", "007"),
    ]


def test_backslashes_and_quoted_breaks(spark, export):
    path = export('A,B\n"a\\",b\n"two\nlines",c\n')
    rows = read_sales_csv(spark, path, multiline=True, keep_order=False)
    assert [tuple(r) for r in rows.collect()] == [("a\\", "b"), ("two\nlines", "c")]


def test_short_rows_are_filled_and_long_rows_fail(spark, export):
    short = export("A,B,C\n1,2\n3,4,5\n", "short.csv")
    assert [tuple(r) for r in read_sales_csv(spark, short, keep_order=False).collect()] == [("1", "2", None), ("3", "4", "5")]
    long = export("A,B,C\n1,2,3,4\n", "long.csv")
    with pytest.raises(Exception, match="more cells than the header"):
        read_sales_csv(spark, long).collect()
    kept = read_sales_csv(spark, long, ragged="truncate", keep_order=False)
    assert [tuple(r) for r in kept.collect()] == [("1", "2", "3")]


def test_pruned_scan(spark, export):
    path = export("A,B,C\n1,2,3\n")
    rows = read_sales_csv(spark, path, ["C", "A"], ragged="truncate", keep_order=False)
    assert [tuple(r) for r in rows.collect()] == [("3", "1")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<A:string,C:string>" in plan
    with pytest.raises(ValueError, match="Nope"):
        read_sales_csv(spark, path, ["Nope"])


def test_files_with_other_headers_are_refused(spark, export):
    one, two = export("A,B\n1,2\n", "one.csv"), export("B,A\n2,1\n", "two.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_sales_csv(spark, [one, two]).collect()


def test_odd_headers_are_compared_too(spark, export):
    one, two = export("A,,B,B\n1,2,3,4\n", "one.csv"), export("B,A,,B\n9,8,7,6\n", "two.csv")
    with pytest.raises(ValueError, match="different headers"):
        read_sales_csv(spark, [one, two])
    same = export("A,,B,B\n5,6,7,8\n", "three.csv")
    rows = read_sales_csv(spark, [one, same], keep_order=False)
    assert rows.columns == ["A", "Unnamed: 1", "B", "B.1"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "2", "3", "4"), ("5", "6", "7", "8")]
    longer = export("A,,B,B,X\n5,6,7,8,9\n", "four.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_sales_csv(spark, [one, longer]).collect()


def test_row_order_survives_many_splits(spark, export):
    path = export("N\n" + "".join(f"{i:06d}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_sales_csv(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        shuffled = rows.repartition(7).orderBy("source_file", "source_row")
        assert [r.N for r in shuffled.select("N").collect()] == [f"{i:06d}" for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ingest_leaves_the_file_alone_and_drops_private_cells(spark, export):
    path = export("\n".join([HEADER, sales_row(), sales_row(qty="three")]) + "\n")
    before = Path(path).read_bytes()
    cleaned = ingest_csv(spark, path)
    assert not set(PRIVATE_COLUMNS) & set(cleaned.columns)
    assert [r.qty for r in cleaned.orderBy("source_row").collect()] == [1.0, None]
    assert Path(path).read_bytes() == before


def test_csv_writer_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [('say "hi"', None, "$1.00"), ("a,b", "", "N/A"), ("back\\slash", " x ", None)], "a string, b string, c string"
    )
    write_sales_csv(df, str(tmp_path / "out"))
    back = read_sales_csv(spark, str(tmp_path / "out"), keep_order=False)
    expected = {('say "hi"', None, "$1.00"), ("a,b", None, "N/A"), ("back\\slash", " x ", None)}
    assert {tuple(r) for r in back.collect()} == expected


def test_views_replace_each_other(spark):
    load_views({"some_table": spark.range(3)})
    load_views({"some_table": spark.range(5)})
    assert query_table(spark, "some_table").count() == 5


@pytest.mark.parametrize("by_month", [False, True])
def test_tables_survive_storage(spark, folder, tmp_path, by_month):
    raw = order_lines.raw_export(spark, folder)
    lazy = build_and_load(clean(raw), order_lines.LINE_ORDER)
    expected = {name: df.count() for name, df in lazy.items()}
    stored = build_and_load(clean(raw), order_lines.LINE_ORDER, folder=str(tmp_path), by_month=by_month)
    assert {name: df.count() for name, df in stored.items()} == expected
    units = spark.sql("SELECT category, SUM(units_sold) AS units FROM daily_item_sales GROUP BY category")
    lines = spark.sql("SELECT category, SUM(qty) AS units FROM line_items GROUP BY category")
    assert units.exceptAll(lines).isEmpty() and lines.exceptAll(units).isEmpty()


def test_month_layout_reads_only_the_months_of_a_range(spark, folder, tmp_path):
    lines = order_lines.sales_lines(spark, folder)
    save_tables({"line_items": lines}, str(tmp_path), by_month=True)
    stored = open_tables(spark, str(tmp_path), ["line_items"])["line_items"]
    some = between_dates(stored, "1996-03-10", "1996-04-20")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_month" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert some.count() == between_dates(lines, "1996-03-10", "1996-04-20").count() > 0


def test_invalid_exports_load_nothing(spark, export, tmp_path):
    path = export("\n".join([HEADER, sales_row(), sales_row(qty="N/A")]) + "\n")
    spark.catalog.dropTempView("line_items")
    for folder in (None, str(tmp_path / "tables")):
        with pytest.raises(ContractError, match=r"1 issue\(s\) in 2 rows"):
            build_and_load(ingest_csv(spark, path), folder=folder)
    lacking = ingest_csv(spark, path).drop("sku")
    with pytest.raises(ContractError, match=r"2 issue\(s\) in 2 rows"):
        build_and_load(lacking, folder=str(tmp_path / "tables"))
    assert not spark.catalog.tableExists("line_items")
    assert not list((tmp_path / "tables").glob("**/line_items"))


def test_rejected_and_failed_loads_change_nothing(spark, export, tmp_path, monkeypatch):
    """A good load stays readable, table by table, whatever happens to the next one."""
    folder = str(tmp_path / "kept")
    good = export("\n".join([HEADER, sales_row(), sales_row(basket="SQ9")]) + "\n", "good.csv")
    build_and_load(ingest_csv(spark, good), folder=folder)
    names = ["cleaned", "line_items", "transactions", "daily_item_sales"]
    before = {name: df.collect() for name, df in open_tables(spark, folder, names).items()}
    bad = export("\n".join([HEADER, sales_row(qty="N/A")]) + "\n", "bad.csv")
    with pytest.raises(ContractError):
        build_and_load(ingest_csv(spark, bad), folder=folder)
    other = export("\n".join([HEADER, sales_row(basket="SQ7")]) + "\n", "other.csv")
    with monkeypatch.context() as patch:
        patch.setattr("tillscope.sources.tables.build_daily_item_sales", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build_and_load(ingest_csv(spark, other), folder=folder)
    assert {name: df.collect() for name, df in open_tables(spark, folder, names).items()} == before
    build_and_load(ingest_csv(spark, other), folder=folder)
    assert open_tables(spark, folder, names)["transactions"].first().transaction_id == "SQ7"


def test_whole_path_from_csv_to_baskets(spark, export, tmp_path):
    rows = [sales_row(basket="SQ2"), sales_row(basket="SQ1"), sales_row(basket="SQ2", SKU="SNK-002")]
    tables = build_and_load(ingest_csv(spark, export("\n".join([HEADER, *rows]) + "\n")), folder=str(tmp_path / "t"))
    items = {(r.line_item_id, r.sku) for r in tables["line_items"].collect()}
    assert items == {("SQ2-1", "SNK-001"), ("SQ1-1", "SNK-001"), ("SQ2-2", "SNK-002")}
    assert {(r.transaction_id, r.num_line_items) for r in tables["transactions"].collect()} == {("SQ1", 1), ("SQ2", 2)}


def test_files_follow_each_other_by_path(spark, tmp_path):
    """A basket that continues in the next file keeps its order."""
    folder = tmp_path / "exports"
    folder.mkdir()
    for day, prices in (("2025-01-02 b", (4, 5, 6, 7)), ("2025-01-01 a%", (1, 2)), ("2025-01-03", (8,))):
        rows = [sales_row(**{"Net Sales": f"${p}.00"}) for p in prices]
        (folder / f"{day}.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    cleaned = ingest_csv(spark, str(folder))
    assert "Join" not in cleaned._jdf.queryExecution().executedPlan().toString()
    rows = cleaned.orderBy("source_file", "source_row").collect()
    assert [int(r.net_sales) for r in rows] == [1, 2, 4, 5, 6, 7, 8]


@pytest.mark.parametrize(
    "header, names",
    [
        ("Tax,B,Tax,Tax", ["Tax", "B", "Tax.1", "Tax.2"]),
        ("A,,C,", ["A", "Unnamed: 1", "C", "Unnamed: 3"]),
        ("a,A,b,c", ["a", "A", "b", "c"]),
        ("A.x,B`y,c d, e ", ["A.x", "B`y", "c d", " e "]),
        ("﻿A,B,C,D", ["A", "B", "C", "D"]),
    ],
)
def test_odd_headers(spark, export, header, names):
    rows = read_sales_csv(spark, export(f"{header}\r\n1,2,3,4\r\n\r\n5,6,7,8\r\n"), keep_order=False)
    assert rows.columns == names
    assert [tuple(r) for r in rows.collect()] == [("1", "2", "3", "4"), ("5", "6", "7", "8")]


def test_a_file_without_header_is_an_error(spark, export):
    with pytest.raises(ValueError, match="no header"):
        read_sales_csv(spark, export(""))


def test_a_file_without_rows_gives_none(spark, export):
    path = export(HEADER + "\n")
    assert ingest_csv(spark, path).isEmpty()


def test_rows_can_be_counted_without_reading_cells(spark, export):
    path = export("\n".join([HEADER, sales_row(), "01/15/2025", sales_row()]) + "\n")
    assert ingest_csv(spark, path).count() == 3
    assert read_sales_csv(spark, path, ["Date"], keep_order=False).count() == 3
    long = export("A,B\n1,2\n1,2,3\n", "long.csv")
    with pytest.raises(Exception, match="more cells than the header"):
        read_sales_csv(spark, long, ["A"], keep_order=False).count()


def test_long_rows_fail_the_cleaned_scan_too(spark, export):
    """Dropping the private columns at the end of a row must not hide surplus cells behind them."""
    path = export("\n".join([HEADER, sales_row(), sales_row() + ",surplus"]) + "\n")
    with pytest.raises(Exception, match="more cells than the header"):
        ingest_csv(spark, path).select("sku").collect()
    assert ingest_csv(spark, path, ragged="truncate").count() == 2


def test_compressed_export_is_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sales_csv, "FILE_ROWS", 2)
    rows = spark.createDataFrame([(f"T{i}", f"a, \"b\" {i} ") for i in range(5)], "`Transaction ID` string, Item string")
    path = tmp_path / "out"
    write_sales_csv(rows.coalesce(1), str(path), compression="lz4")
    assert len(list(path.glob("*.csv.lz4"))) == 3 and not list(path.glob("*.csv"))
    back = read_sales_csv(spark, str(path), keep_order=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_export_reconciliation_stores_compactly(spark, folder, monkeypatch, tmp_path):
    from tillscope.plans import reconcile

    for module in (queries, reconcile):
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    assert queries.QUERIES["export_reconciliation"](spark, folder).where("status <> 'PASS'").isEmpty()
    tables = [path.parent.name for path in tmp_path.glob("tables/load-*/*/*.zstd.parquet")]
    assert {"cleaned", "line_items", "transactions", "daily_item_sales"} <= set(tables)
    assert list(tmp_path.glob("raw-kpis/*.zstd.parquet"))


def test_lines_are_joined_without_sorting(spark, folder):
    joined = order_lines.sales_lines(spark, folder)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan


@pytest.mark.parametrize(("name", "step"), [("differing_baskets", "_spoiled"), ("grain_consistency", "build_tables")])
def test_lines_are_put_together_once(spark, folder, monkeypatch, name, step):
    inputs, own = [], getattr(queries, step)
    monkeypatch.setattr(queries, step, lambda lines, *rest: inputs.extend(lines.inputFiles()) or own(lines, *rest))
    queries.QUERIES[name](spark, folder)
    assert inputs and not any("lineitem.parquet" in path for path in inputs)


def test_lines_of_a_basket_are_together(spark, folder):
    """Groupings by basket follow the join with the orders without another shuffle of the lines."""
    from tillscope.plans.tables import build_daily_item_sales, build_transactions

    lines, order = order_lines.sales_lines(spark, folder), order_lines.LINE_ORDER
    # Lines and parts by part, both sides by basket; the rollup once more by day and sku.
    for df, shuffles in ((build_transactions(lines, order), 4), (build_daily_item_sales(lines, order), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles
        assert "partial_sum" in plan


@pytest.mark.parametrize("name", ["kpi_reconciliation", "reconciliation_verdict"])
def test_reconciliation_stores_the_cells_it_reads(spark, folder, monkeypatch, tmp_path, name):
    from tillscope.plans import reconcile

    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    queries.QUERIES[name](spark, folder)
    stored = spark.read.parquet(f"{tmp_path}/raw")
    assert set(stored.columns) == {*reconcile.RAW_KPI_COLUMNS, "Time"}
    assert stored.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
