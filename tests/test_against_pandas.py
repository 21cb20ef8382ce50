"""Parsers and reports against pandas on generated input."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.functions.parsing import parse_date, parse_money, parse_number, parse_timestamp
from tillscope.plans import metrics

CHANCE = random.Random(20250115)
NOISE = " \t/:-$.,0123456789aApPmMeEdf"


def mutated(texts, times):
    """The texts themselves, and each with a few characters dropped, doubled or replaced."""
    found = list(texts)
    for text in texts:
        for _ in range(times):
            chars = list(text)
            for _ in range(CHANCE.randint(1, 2)):
                at = CHANCE.randrange(len(chars) + 1)
                kind = CHANCE.random()
                if kind < 0.4 and at < len(chars):
                    del chars[at]
                elif kind < 0.7 and at < len(chars):
                    chars[at] = CHANCE.choice(NOISE)
                else:
                    chars.insert(at, CHANCE.choice(NOISE))
            found.append("".join(chars))
    return found


def days(n):
    return [(dt.date(1990, 1, 1) + dt.timedelta(days=CHANCE.randrange(20_000))).strftime("%m/%d/%Y") for _ in range(n)]


def clocks(n):
    return [(dt.datetime(2000, 1, 1) + dt.timedelta(seconds=CHANCE.randrange(86_400))).strftime("%I:%M:%S %p") for _ in range(n)]


def by_spark(spark, expression, *columns):
    df = spark.createDataFrame(list(zip(range(len(columns[0])), *columns)), "i int, " + ", ".join(f"c{n} string" for n in range(len(columns))))
    result = df.select("i", expression(*(F.col(f"c{n}") for n in range(len(columns)))).alias("v"))
    return [row.v for row in result.orderBy("i").collect()]


def differences(texts, ours, theirs):
    return [(t, a, b) for t, a, b in zip(texts, ours, theirs) if a != b]


@pytest.mark.parametrize("spoil", ["date", "time"])
def test_timestamps(spark, spoil):
    date, time = days(400), clocks(400)
    if spoil == "date":
        date = mutated(date, 8)
        time = [CHANCE.choice(time) for _ in date]
    else:
        time = mutated(time, 8)
        date = [CHANCE.choice(date) for _ in time]
    joined = pd.Series(date).str.strip() + " " + pd.Series(time).str.strip()
    theirs = pd.to_datetime(joined, format="%m/%d/%Y %I:%M:%S %p", errors="coerce")
    theirs = [None if pd.isna(v) else v.to_pydatetime() for v in theirs]
    ours = by_spark(spark, parse_timestamp, date, time)
    assert sum(v is None for v in theirs) > 100
    assert differences(joined, ours, theirs) == []


def test_days_alone(spark):
    date = mutated(days(400), 8)
    theirs = pd.to_datetime(pd.Series(date).str.strip(), format="%m/%d/%Y", errors="coerce")
    ours = by_spark(spark, parse_date, date)
    assert differences(date, ours, [None if pd.isna(v) else v.to_pydatetime() for v in theirs]) == []


def test_quantities(spark):
    texts = mutated([str(CHANCE.randrange(1, 500)) for _ in range(300)] + ["3.5", "1e3", "-2", ".5", "7.", "+4"], 8)
    theirs = pd.to_numeric(pd.Series(texts), errors="coerce").astype(float)
    theirs = [None if pd.isna(v) or v in (float("inf"), float("-inf")) else v for v in theirs]
    assert differences(texts, by_spark(spark, parse_number, texts), theirs) == []


def test_money(spark):
    import re

    good = [f"{CHANCE.choice(['', '-'])}${CHANCE.randrange(100_000) / 100:.2f}" for _ in range(300)]
    texts = mutated(good + ["$5", "$0.5", "-$7"], 8)
    shape = re.compile(r"-?\$[0-9]+(\.[0-9]{1,2})?")
    theirs = [Decimal(t.strip().replace("$", "")).quantize(Decimal("0.01")) if shape.fullmatch(t.strip()) else None for t in texts]
    assert differences(texts, by_spark(spark, parse_money, texts), theirs) == []


def test_limits_of_the_contract(spark):
    """Years that nanoseconds cannot hold are null, to the second."""
    cases = [
        ("01/15/0205", "02:00:00 PM", False), ("09/21/1677", "12:12:43 AM", False), ("09/21/1677", "12:12:44 AM", True),
        ("04/11/2262", "11:47:16 PM", True), ("04/11/2262", "11:47:17 PM", False), ("01/01/9999", "01:00:00 AM", False),
    ]
    got = by_spark(spark, parse_timestamp, [c[0] for c in cases], [c[1] for c in cases])
    assert [v is not None for v in got] == [c[2] for c in cases]
    alone = by_spark(spark, parse_date, ["09/21/1677", "09/22/1677", "04/11/2262", "04/12/2262"])
    assert [v is not None for v in alone] == [False, True, True, False]


# Two quiet months, a month without sales, refunds that make a month zero, ties and null items.
SALES = [
    ("K1", "2031-01-05", "pear", "fruit", 2, "4.00"), ("K1", "2031-01-05", "fig", "fruit", 2, "6.00"),
    ("K2", "2031-01-31", None, "other", 1, "2.50"), ("K3", "2031-03-01", "pear", "fruit", 4, "10.00"),
    ("K3", "2031-03-01", "nut", "dry", 4, "-10.00"), ("K4", "2031-04-30", "nut", "dry", 1, "5.00"),
    ("K5", "2031-05-01", "fig", "fruit", 3, "7.50"), ("K5", "2031-05-01", "pear", "dry", None, "2.50"),
]


def test_reports(spark):
    """Against sums worked out here in plain Python."""
    schema = "transaction_id string, day string, item string, category string, qty bigint, net string"
    lines = spark.createDataFrame(SALES, schema).selectExpr(
        "transaction_id", "cast(day as date) as date", "item", "category", "qty", "cast(net as decimal(18,2)) as net_sales"
    )
    start, end = "2031-01-06", "2031-05-01"
    inside = [row for row in SALES if start <= row[1] <= end]
    net = sum(Decimal(row[5]) for row in inside)

    kpis = metrics.headline_kpis(lines, start, end).first()
    assert (kpis.net_sales, kpis.units) == (net, sum(row[4] or 0 for row in inside))
    assert (kpis.transactions, kpis.distinct_items) == (4, 3)
    assert kpis.avg_basket == pytest.approx(float(net) / 4)

    by_category = {}
    for row in inside:
        by_category[row[3]] = by_category.get(row[3], 0) + Decimal(row[5])
    mix = metrics.category_mix(lines, start, end).collect()
    assert {r.category: r.net_sales for r in mix} == by_category
    assert [r.net_sales for r in mix] == sorted(by_category.values(), reverse=True)
    assert {r.category: round(r.pct_of_total, 9) for r in mix} == {
        name: round(float(value / net * 100), 9) for name, value in by_category.items()
    }

    # February is missing: March is compared with January; after a month of zero there is no change to give.
    trend = metrics.month_over_month(lines, "2031-01-01", end).collect()
    assert [(r.month.month, float(r.net_sales), r.mom_pct_change) for r in trend] == [
        (1, 12.5, None), (3, 0.0, -100.0), (4, 5.0, None), (5, 10.0, 100.0),
    ]

    units = {}
    for row in SALES:
        units[row[2]] = units.get(row[2], 0) + (row[4] or 0)
    top = metrics.top_items_by_units(lines, "2031-01-01", end, 2).collect()
    assert [r.units for r in top] == sorted(units.values(), reverse=True)[:2]
    assert all(units[r.item] == r.units for r in top)
