import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tillscope.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # A zone with daylight saving: nothing may depend on the session time zone.
    session = local_session(8, **{"spark.sql.session.timeZone": "America/Chicago"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def lines_of(spark):
    """Line items from short tuples (basket, day, sku, item, category, qty, net)."""

    def build(rows):
        schema = "transaction_id string, day string, sku string, item string, category string, qty bigint, net string"
        return spark.createDataFrame(rows, schema).selectExpr(
            "transaction_id", "cast(day as date) as date", "sku", "item", "category", "qty",
            "cast(net as decimal(18,2)) as net_sales",
        )

    return build


@pytest.fixture
def export(tmp_path):
    """Write a small export file and return its path."""

    def write(text, name="export.csv"):
        path = tmp_path / name
        path.write_text(text, newline="")
        return str(path)

    return write
