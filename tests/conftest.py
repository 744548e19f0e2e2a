from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runlens.plans import prepare  # noqa: E402
from runlens.schema import TABLES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("runlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.debug.maxToStringFields", "1000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of one of the three tables from dicts; what is not given is null."""

    def build(table: str, *rows: dict):
        fields = TABLES[table].fields
        for row in rows:
            assert set(row) <= {f.name for f in fields}, row
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], TABLES[table])

    return build


def uuid7(text: str, tail: int = 0) -> str:
    """A version-7 id of that time."""
    ms = int((at(text) - datetime(1970, 1, 1)).total_seconds() * 1000)
    h = f"{ms:012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-{tail:012x}"


def values(df, *columns):
    """Rows as a sorted list of tuples."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
