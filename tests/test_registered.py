"""Every registered query against DuckDB on the smallest test tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from tests.compare import TABLES, connect, differences
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# The queries of the text operators have tests of their own.
OWN = [name for name in registered.queries() if name not in registered.text_queries()]


@pytest.mark.parametrize("name", OWN)
def test_equals_duckdb(spark, duck, name):
    assert differences(registered.queries()[name](spark, SF_DIR), duck, registered.oracle_sql()[name]) == []


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(OWN) <= set(registered.oracle_sql()) <= set(registered.queries())


def test_pages_continue_after_lines_that_share_their_id(spark, tmp_path):
    """Every line comes again with the same id at another time, as some do in larger tables."""
    for table in TABLES:
        if table != "lineitem":
            (tmp_path / f"{table}.parquet").symlink_to(f"{SF_DIR}/{table}.parquet")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    again = lines.withColumns({"l_partkey": F.col("l_partkey") + 17, "l_suppkey": F.col("l_suppkey") - 31})
    lines.unionByName(again).coalesce(1).write.parquet(str(tmp_path / "lines"))
    (tmp_path / "lineitem.parquet").symlink_to(next((tmp_path / "lines").glob("*.parquet")))
    name = "activity_logs_many_pages"
    duck = connect(str(tmp_path))
    assert differences(registered.queries()[name](spark, str(tmp_path)), duck, registered.oracle_sql()[name]) == []
