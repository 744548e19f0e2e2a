from __future__ import annotations

import pytest
from pyspark.sql import types as T

from runlens import operators as op
from runlens.plans import in_window, within_bounds
from runlens.plans.windows import id_bounds
from runlens.schema import ACTIVITY, TABLES, conform
from runlens.sources import SourceRegistry, Tables, jdbc_options, month_coverage, read_parquet, read_table, testdata, write_by_month
from tests.conftest import SF_DIR, at, uuid7, values

WINDOW = {"since": "2024-01-01", "until": "2024-04-01"}


def rows(prefix, n):
    times = [f"2024-0{1 + i % 3}-15T00:00:00" for i in range(n)]
    return [{"id": uuid7(t, i), "created_on": at(t), "application": prefix, "status": "succeeded"} for i, t in enumerate(times)]


@pytest.fixture(scope="module")
def by_month(spark, make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "activity")
    write_by_month(make("activity", *rows("a", 30)), path, "activity", partitions=3)
    return read_parquet(spark, path, "activity")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_conform_fills_and_casts(spark):
    df = conform(spark.sql("SELECT 'x' AS id, TIMESTAMP '2024-01-01 00:00:00' AS created_on, 3 AS created_by, 1 AS junk"), "activity")
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in ACTIVITY]
    assert df.first()["created_on"] == at("2024-01-01") and df.first()["target"] is None


def test_written_table_reads_back(by_month):
    assert by_month.columns == [f.name for f in ACTIVITY] + ["created_month"]
    assert by_month.schema["created_month"].dataType == T.IntegerType() and by_month.count() == 30
    assert values(by_month.select("created_month").distinct()) == [(202401,), (202402,), (202403,)]


def test_window_prunes_months_and_row_groups(by_month):
    plan = plan_of(in_window(by_month, "activity", at("2024-02-01"), at("2024-02-20")).select("id"))
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "created_month" in partition_filters
    assert "GreaterThanOrEqual(created_on" in plan.split("PushedFilters: [")[1].split("]")[0]
    overview = op.fleet_overview(by_month, since="2024-02-01", until="2024-03-01")
    assert overview.first()["runs"] == 10 and "created_month" in plan_of(overview).split("PartitionFilters: [")[1]


def test_id_bounds_prune_months(spark, by_month):
    ids = spark.createDataFrame([(uuid7("2024-02-15T00:00:00", 1),)], "activity_id string")
    kept = within_bounds(by_month, "activity", id_bounds(ids))
    plan = plan_of(kept)
    # The months that the ids touch prune the scan as it runs, see tests/test_bounds.py.
    assert "dynamicpruning" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert kept.count() == 10
    undated = ids.unionByName(spark.createDataFrame([("legacy",)], "activity_id string"))
    assert within_bounds(by_month, "activity", id_bounds(undated)).count() == 30


def test_cursor_literal_is_pushed_down(by_month):
    first = op.activities_list(by_month, limit=5, **WINDOW)
    cursor = first.where("next_cursor IS NOT NULL").first()["next_cursor"]
    plan = plan_of(op.activities_list(by_month, limit=5, cursor=cursor, **WINDOW))
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert "LessThan(id" in pushed and "base64" not in plan


def test_only_needed_columns_are_read(by_month):
    schema = plan_of(op.fleet_overview(by_month, **WINDOW)).split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} <= {
        "created_on", "application", "status", "started_on", "completed_on", "records_impacted",
    }


def test_registry(spark, make):
    def source(prefix, n):
        tables = {"activity": make("activity", *rows(prefix, n))}
        return Tables(lambda name: tables[name])

    registry = SourceRegistry({"Prod": source("p", 3), "Test": source("t", 2)})

    def query(tables):
        return op.fleet_overview(tables.activity, **WINDOW)

    assert values(registry.run(query), "application", "runs", "source") == [("p", 3, "Prod")]
    assert values(registry.run(query, " tEST "), "application", "source") == [("t", "Test")]
    assert values(registry.run_all(query), "application", "source") == [("p", "Prod"), ("t", "Test")]
    assert SourceRegistry({"a": source("a", 1), "b": source("b", 1)}, default="B").resolve(" ")[0] == "b"
    with pytest.raises(ValueError, match="'x' is none of Prod, Test"):
        registry.resolve("x")
    with pytest.raises(ValueError, match="is none of"):
        SourceRegistry({"a": source("a", 1)}, default="z")


def test_tables_open_on_first_use():
    opened = []
    tables = Tables(lambda name: opened.append(name) or name)
    assert tables.activity == "activity" and tables.activity == "activity" and opened == ["activity"]


def test_catalog_table(spark, make):
    make("activity", *rows("a", 3)).createOrReplaceTempView("some_runs")
    assert read_table(spark, "some_runs", "activity").count() == 3


def test_jdbc_options():
    options = jdbc_options(
        "jdbc:mysql://h/db", "log_entries", since=at("2024-01-01"), until=at("2024-02-01"), partitions=8, properties={"user": "u"}
    )
    assert options["dbtable"] == "log_entries" and options["partitionColumn"] == "event_time_utc"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("2024-01-01 00:00:00", "2024-02-01 00:00:00", "8")
    assert options["user"] == "u"


def test_derived_tables_have_the_declared_schemas(spark):
    tables = testdata.tables(spark, SF_DIR)
    for name, schema in TABLES.items():
        df = getattr(tables, name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
    assert tables.activity.count() == spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    assert tables.activity.select("id").distinct().count() == tables.activity.count()
    assert tables.log_entries.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


def test_months_are_counted_from_footers(spark, make, tmp_path):
    path = str(tmp_path / "activity")
    # A time before 1970, and a month in two files.
    times = ["1969-12-31T23:59:59.999999", "2024-01-01T00:00:00", "2024-01-31T23:59:59.999999", "2024-02-10T00:00:00.000001"]
    lines = [{"id": f"r{i}", "created_on": at(t), "status": "s", "application": f"a{i}"} for i, t in enumerate(times)]
    write_by_month(make("activity", *lines, lines[1]), path, "activity", partitions=4)
    months = month_coverage(spark, path, "activity")
    assert values(months) == [
        (196912, 1, "1969-12-31T23:59:59.999999Z", "1969-12-31T23:59:59.999999Z"),
        (202401, 3, "2024-01-01T00:00:00.000000Z", "2024-01-31T23:59:59.999999Z"),
        (202402, 1, "2024-02-10T00:00:00.000001Z", "2024-02-10T00:00:00.000001Z"),
    ]
    explained = months._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = explained.split("PushedAggregation: [")[1].split("]")[0]
    assert "COUNT(*)" in pushed and "MIN(created_on_micros)" in pushed and "PushedGroupBy: [created_month]" in explained
    assert values(month_coverage(spark, path, "activity", first_month=202402).select("month")) == [(202402,)]
    bounded = month_coverage(spark, path, "activity", last_month=202401, first_month=202401)
    assert bounded.first()["rows"] == 3 and "COUNT(*)" in plan_of(bounded)
    # The other readers are not touched by it.
    assert "PushedFilters" in plan_of(read_parquet(spark, path, "activity")) and read_parquet(spark, path, "activity").count() == 5


def test_an_empty_table_has_no_months(spark, make, tmp_path):
    write_by_month(make("log_entries"), str(tmp_path / "lines"), "log_entries")
    assert month_coverage(spark, str(tmp_path / "lines"), "log_entries").collect() == []
