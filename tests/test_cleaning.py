import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillscope.functions.headers import snake_case
from tillscope.functions.parsing import parse_clock, parse_day, parse_money, parse_number
from tillscope.names import PRIVATE_COLUMNS, RAW_COLUMNS
from tillscope.operators.cleaning import clean, drop_private, normalize_headers, parse_amounts, parse_datetime


def parsed(spark, expression, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "header, name",
    [
        ("Transaction ID", "transaction_id"),
        ("Gross Sales", "gross_sales"),
        ("SKU", "sku"),
        ("Time Zone", "time_zone"),
        ("  Net  Sales ($) ", "net_sales"),
        ("__Qty__", "qty"),
        ("Preis (€)", "preis"),
    ],
)
def test_headers(header, name):
    assert snake_case(header) == name


def test_colliding_headers_are_named(spark):
    df = spark.createDataFrame([("a", "b")], ["Net Sales", "net-sales"])
    with pytest.raises(ValueError, match="net_sales"):
        normalize_headers(df)


def test_timestamps_combine_and_bad_ones_become_null(spark):
    cases = [
        ("01/15/2025", "02:30:00 PM", dt.datetime(2025, 1, 15, 14, 30)),
        ("1/5/2025", "2:3:4 pm", dt.datetime(2025, 1, 5, 14, 3, 4)),
        (" 01/ 5/2025", "12:00:00 AM ", dt.datetime(2025, 1, 5)),
        ("01/05/2025", "12:59:59 pm", dt.datetime(2025, 1, 5, 12, 59, 59)),
        ("01/05/2025", "02:30:00   PM", dt.datetime(2025, 1, 5, 14, 30)),
        # Skipped by the clock change in the session's zone, yet a valid local time.
        ("03/09/2025", "02:30:00 AM", dt.datetime(2025, 3, 9, 2, 30)),
        ("02/29/2024", "01:00:00 AM", dt.datetime(2024, 2, 29, 1)),
        ("12/31/2024", "11:59:61 PM", dt.datetime(2025, 1, 1, 0, 0, 1)),
        ("12/31/2024", "11:59:62 PM", None),
        ("Not a date", "02:30:00 PM", None),
        ("13/45/2025", "02:30:00 PM", None),
        ("02/30/2025", "02:30:00 PM", None),
        ("02/29/2025", "02:30:00 PM", None),
        ("2025-01-15", "02:30:00 PM", None),
        ("01/15/25", "02:30:00 PM", None),
        ("01/15/2025", "14:30:00", None),
        ("01/15/2025", "14:30:00 PM", None),
        ("01/15/2025", "00:30:00 AM", None),
        ("01/15/2025", "02:60:00 PM", None),
        ("01/15/2025", "02:30 PM", None),
        ("01/15/2025", None, None),
        (None, "02:30:00 PM", None),
        ("", "", None),
    ]
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(cases)], "i int, date string, time string")
    rows = parse_datetime(df).orderBy("i").collect()
    assert [row.transaction_ts for row in rows] == [expected for *_, expected in cases]
    assert [row.date for row in rows] == [expected and expected.date() for *_, expected in cases]


def test_day_alone_when_there_is_no_time(spark):
    df = spark.createDataFrame([("01/15/2025",), ("02/30/2025",)], "date string")
    rows = parse_datetime(df).collect()
    assert [(r.transaction_ts, r.date) for r in rows] == [(dt.datetime(2025, 1, 15), dt.date(2025, 1, 15)), (None, None)]


def test_money(spark):
    good = {"$12.34": "12.34", "-$1.23": "-1.23", " $5 ": "5.00", "\t$0.5\n": "0.50", "$0.00": "0.00", "-$0.00": "0.00"}
    bad = [
        "free", "$$7.00", "n.a.", "==", "", None, "12.34", "$1,234.00", "$-1.23", "$.50", "$12.",
        "$12.345", "($1.00)", "+$1.00", "- $1.00", "$ 1.00", "$1.2.3", "$1e3",
    ]
    assert parsed(spark, parse_money, list(good)) == [Decimal(v) for v in good.values()]
    assert parsed(spark, parse_money, bad) == [None] * len(bad)


def test_usual_shapes_are_parsed_without_stripping(spark):
    """A usual cell takes the first branch, an odd one with the same digits gives the same value."""
    pairs = [
        (parse_day, "02/28/2025", "\u20032/28/2025\n"), (parse_money, "-$1.23", "\x85-$1.23\u2028"),
        (parse_number, "007.50", "\t+7.5 "), (parse_day, "02/30/2025", " 02/30/2025"), (parse_day, "01/01/0000", "1/1/0000"),
        (parse_clock, "12:05:07 am", " 12:5:7\tAM\n"), (parse_clock, "11:59:61 PM", "11:59:61  pm"),
    ]
    for parse, usual, odd in pairs:
        plain, other = parsed(spark, parse, [usual, odd])
        assert plain == other, (usual, odd)
    assert parsed(spark, parse_clock, ["11:59:61 PM"]) == [dt.timedelta(days=1, seconds=1)]
    for parse in (parse_day, parse_money, parse_number):
        rows = spark.createDataFrame([("1",)], "t string").select(parse(F.col("t")))
        branches = rows._jdf.queryExecution().analyzed().toString()
        assert re.search(r"RLIKE\(t#|t#\d+ RLIKE", branches).start() < branches.index("trim("), branches


def test_quantity(spark):
    good = {"3": 3.0, " 3 ": 3.0, "3.0": 3.0, "-2": -2.0, "+4": 4.0, ".5": 0.5, "2.": 2.0, "1e2": 100.0}
    bad = ["a pair", "n.a.", "", "+", "7 pcs", None, "3d", "3f", "inf", "-Infinity", "nan", "1e999", "1_000", "0x10"]
    assert parsed(spark, parse_number, list(good)) == list(good.values())
    assert parsed(spark, parse_number, bad) == [None] * len(bad)


def test_amounts_only_touch_present_columns(spark):
    df = spark.createDataFrame([("$12.34", "3", "x")], ["gross_sales", "qty", "item"])
    assert parse_amounts(df).collect() == [(Decimal("12.34"), 3.0, "x")]


def test_private_columns_go_and_others_stay(spark):
    df = spark.createDataFrame([("Jane", "1", "BEV-001")], ["customer_name", "customer_id", "sku"])
    assert drop_private(df).columns == ["sku"]


def test_clean_runs_all_steps(spark):
    cells = {name: "x" for name in RAW_COLUMNS} | {
        "Date": "01/15/2025", "Time": "02:30:00 PM", "Qty": "3", "Gross Sales": "$3.00", "Discounts": "N/A",
        "Net Sales": "$3.00", "Tax": "$0.21",
    }
    df = spark.createDataFrame([tuple(cells.values())], list(cells))
    cleaned = clean(df)
    assert not set(PRIVATE_COLUMNS) & set(cleaned.columns)
    types = dict(cleaned.dtypes)
    assert types["transaction_ts"] == "timestamp_ntz" and types["date"] == "date" and types["qty"] == "double"
    assert types["net_sales"] == "decimal(18,2)"
    row = cleaned.first()
    assert row.gross_sales == Decimal("3.00") and row.discounts is None and row.qty == 3.0
