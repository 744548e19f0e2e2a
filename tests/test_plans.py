"""Properties of plans that matter on a cluster and do not show in results."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from runlens import operators as op
from runlens.llm.session import ready
from runlens.plans import checkpoint_dir, prepare, settled
from tests.conftest import SF_DIR, at, uuid7


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# page_manifest numbers pages by a table with a row for each partition, which is cross joined
# with nothing but has no key of its own; the text operators have tests of their own.
NO_CROSS = [n for n in registered.queries() if n != "page_manifest" and n not in registered.text_queries()]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_python_no_cross_join(spark, name):
    plan = physical(registered.queries()[name](spark, SF_DIR))
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator


@pytest.mark.parametrize("name", ["recent_failures", "activities_page_1", "logs_search"])
def test_pages_are_top_n(spark, name):
    assert "TakeOrderedAndProject" in physical(registered.queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["catalog_top_keys", "log_summary_categories", "history_stats", "activity_logs_by_id", "activity_detail"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    plan = physical(registered.queries()[name](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and ", Partial" in plan


@pytest.mark.parametrize("name", ["fleet_overview", "log_summary_stats", "id_time_audit"])
def test_rollups_shuffle_once_with_partial_counts(spark, name):
    plan = physical(registered.queries()[name](spark, SF_DIR))
    assert plan.count("Exchange") == 1 and "partial_count" in plan and "SortAggregate" not in plan


def _skewed(spark, make):
    """Half of all log lines belong to one run."""
    hot = uuid7("2024-01-10T00:00:00", 1)
    others = [uuid7("2024-01-10T00:00:00", i) for i in range(2, 60)]
    runs = make("activity", *[{"id": i, "created_on": at("2024-01-10T00:00:00")} for i in [hot, *others]])
    n = 60000
    other = F.element_at(F.array(*[F.lit(o) for o in others]), (F.col("n") % len(others) + 1).cast("int"))
    lines = (
        spark.range(0, n, 1, 8)
        .withColumnRenamed("id", "n")
        .select(
            F.col("n").alias("id"),
            F.timestamp_add("MILLISECOND", F.col("n"), F.lit("2024-01-10").cast("timestamp_ntz")).alias("event_time_utc"),
            (F.col("n") % 6).cast("int").alias("log_level"),
            F.when(F.col("n") % 2 == 0, F.lit(hot)).otherwise(other).alias("activity_id"),
        )
    )
    return runs, lines, hot, n


def test_hot_run_is_split_by_the_count_join(spark, make):
    """With small thresholds the join on run id is planned as a skew join and stays right."""
    runs, lines, hot, n = _skewed(spark, make)
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        edges = make("activity_input")
        details = op.activity_get(runs, edges, lines)
        counted = details.select("id", "log_level_counts")
        rows = {r["id"]: sum(v for v in r["log_level_counts"].asDict().values() if v) for r in counted.collect()}
        assert rows[hot] == n // 2 and sum(rows.values()) == n
        assert "isSkew=true" in physical(counted) or "skew=true" in physical(counted)

        hinted = lines.groupBy("activity_id").agg(F.min("event_time_utc").alias("created_on"))
        stats = op.log_summary_stats(lines, hinted, now=at("2024-01-11"))
        totals = {r["activity_id"]: r["total"] for r in stats.collect()}
        assert totals[hot] == n // 2 and sum(totals.values()) == n
        assert "skew=true" in physical(stats)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lineage_levels_share_their_shuffles(spark):
    """Each level is named several times in the plan and computed once."""
    lineage = registered.queries()["lineage_inputs_d3"](spark, SF_DIR)
    lineage.collect()
    final = physical(lineage).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or "Reused" in final


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) in spark.sparkContext.getCheckpointDir() or spark.sparkContext.getCheckpointDir()
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_scans_are_split_so_that_a_task_can_sort_its_rows(spark):
    split = "spark.sql.files.maxPartitionBytes"
    unset, own = spark.newSession(), spark.newSession()
    unset.conf.unset(split)
    own.conf.set(split, "1m")
    assert prepare(unset).conf.get(split) == "16m"
    assert prepare(own).conf.get(split) == "1m"


def test_shuffles_are_dealt_so_that_a_task_can_sort_its_rows(spark):
    first, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    unset, own = spark.newSession(), spark.newSession()
    own.conf.set(first, "7")
    own.conf.set(size, "1m")
    assert [prepare(unset).conf.get(k) for k in (first, size)] == ["500", "16m"]
    assert [prepare(own).conf.get(k) for k in (first, size)] == ["7", "1m"]
    unset.conf.set("spark.sql.shuffle.partitions", "600")
    assert prepare(unset).conf.get(first, None) != "500"
    unset.conf.set("spark.sql.shuffle.partitions", "4")
    assert prepare(unset).conf.get(first) == "500"
    # Text operators go by the session's values.
    assert ready(unset).conf.get(first, None) != "500" and [ready(own).conf.get(k) for k in (first, size)] == ["7", "1m"]


def test_shuffles_of_settled_rows_go_when_they_are_written(spark):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        names = [f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    rows, before, kept = spark.range(0, 1000, 1, 2).groupBy((F.col("id") % 7).alias("k")).count(), files(), spark.conf.get(cleanup)
    rows.write.format("noop").mode("overwrite").save()
    others = files() - before
    done = settled(rows)
    for _ in range(50):
        if files() <= before | others:
            break
        time.sleep(0.1)
    assert others and files() <= before | others
    assert spark.conf.get(cleanup) == kept and done.count() == 7


def test_pages_by_id_are_windowed_before_the_shuffle_and_stay_dealt(spark, make):
    logs = make("log_entries")
    runs = spark.createDataFrame([("a", "c")], "activity_id string, cursor string")
    assert "FLOOR" in optimized(op.activity_logs(logs, runs, now=at("2024-01-11")))
    hinted = runs.withColumn("created_on", F.lit("2024-01-10").cast("timestamp_ntz"))
    assert "FLOOR" not in optimized(op.activity_logs(logs, hinted, now=at("2024-01-11")))
    cursors = op.activity_logs(logs, limit=2, now=at("2024-01-11")).groupBy("activity_id", "next_cursor").count()
    assert physical(cursors).count("Exchange hashpartitioning") == 1
