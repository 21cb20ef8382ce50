"""From raw text columns to typed, private-free ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.headers import snake_case_all
from tillscope.functions.parsing import parse_date, parse_money, parse_number, parse_timestamp
from tillscope.names import MONEY_COLUMNS, PRIVATE_COLUMNS


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_case_all(df.columns))


def drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*PRIVATE_COLUMNS)


def parse_datetime(df: DataFrame) -> DataFrame:
    """Add ``transaction_ts`` and turn ``date`` into its day.

    A bad time nulls the day as well.  Without a ``time`` column the day alone is parsed.
    """
    if "date" in df.columns:
        date = F.col("date")
        ts = parse_timestamp(date, F.col("time")) if "time" in df.columns else parse_date(date)
        df = df.withColumn("transaction_ts", ts)
    if "transaction_ts" in df.columns:
        df = df.withColumn("date", F.to_date("transaction_ts"))
    return df


def parse_amounts(df: DataFrame) -> DataFrame:
    """Money text to decimals and ``qty`` to a number, for the columns that exist."""
    parsed = {name: parse_money(F.col(name)) for name in MONEY_COLUMNS if name in df.columns}
    if "qty" in df.columns:
        parsed["qty"] = parse_number(F.col("qty").cast("string"))
    return df.withColumns(parsed) if parsed else df


def clean(df: DataFrame) -> DataFrame:
    """All cleaning steps in their fixed order; private columns go before anything is parsed."""
    return df.transform(normalize_headers).transform(drop_private).transform(parse_datetime).transform(parse_amounts)
