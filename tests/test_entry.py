"""Every registered query against its SQL counterpart, on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_queries  # noqa: E402

from __spark_entry__ import entry  # noqa: E402
from tillscope.catalog.oracle import ORACLE  # noqa: E402
from tillscope.catalog.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def connection(folder):
    return check_queries.connect(folder)


def test_flagship(spark):
    assert entry(spark).columns == ["category", "net_sales", "pct_of_total"]


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, folder, name):
    assert check_queries.compare(spark, connection, folder, name) is None
