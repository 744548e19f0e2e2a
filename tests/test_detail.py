from __future__ import annotations

from pyspark.sql import functions as F

from runlens import operators as op
from tests.conftest import at, uuid7, values

CREATED = "2024-01-10T00:00:00"


def run(i, created=CREATED, **more):
    return {"id": uuid7(CREATED, i), "created_on": at(created), "status": "succeeded", **more}


def edge(consumer, producer, created=CREATED):
    return {"activity_id": consumer, "input_activity_id": producer, "input_role": "r", "created_on": at(created)}


def log(i, time, run_id, level=2):
    return {"id": i, "event_time_utc": at(time), "log_level": level, "activity_id": run_id}


def tables(make):
    a, b, far, double = (uuid7(CREATED, i) for i in range(1, 5))
    activity = make(
        "activity",
        run(1, started_on=at("2024-01-11T00:00:00"), completed_on=at("2024-01-12T00:00:00"), parameters='{"k": 1}',
            metrics=" ", created_by=42, parent_activity_id="", error="e" * 600),
        run(2, status=None),
        run(3, created="2024-01-12T00:00:00"),
        run(4, host="old"),
        run(4, created="2024-01-11T00:00:00", host="new"),
        {**run(5), "id": "legacy"},
    )
    edges = make(
        "activity_input",
        edge(a, b), edge(a, "gone"), edge(a, b, "2024-01-12T00:00:00"), edge(b, a), edge("legacy", a, "2020-01-01T00:00:00"),
    )
    logs = make(
        "log_entries",
        log(1, "2024-01-10T00:00:00", a, 0), log(2, "2024-01-12T23:59:59.999999", a, 4), log(3, "2024-01-13T00:00:00", a, 4),
        log(4, "2024-01-09T23:59:59.999999", a, 4), log(5, "2024-01-12T00:00:00", a, 6), log(6, "2024-01-11T00:00:00", b, 2),
    )
    return activity, edges, logs, (a, b, far, double)


def test_detail_of_every_run(make):
    activity, edges, logs, (a, b, far, double) = tables(make)
    rows = {r["id"]: r for r in op.activity_get(activity, edges, logs).collect()}
    # A run created two days after its id time is outside the half-open bracket.
    assert set(rows) == {a, b, double, "legacy"}
    r = rows[a]
    assert r["log_level_counts"].asDict() == {
        "trace": 1, "debug": None, "information": None, "warning": None, "error": 1, "critical": None,
    }
    assert (r["input_count"], r["output_count"]) == (2, 2)
    assert r["parent_activity_id"] is None and r["created_by"] == "42" and r["metrics"] is None
    assert (len(r["error"]), r["error_truncated"], r["duration"]) == (500, True, "1d 0s")
    assert rows[b]["status"] == "" and rows[b]["log_level_counts"]["information"] is None
    assert (rows[b]["input_count"], rows[b]["output_count"]) == (1, 2)
    assert rows[double]["host"] == "new" and rows["legacy"]["input_count"] == 1
    assert op.activity_get(activity, edges, logs, full=True).where(F.col("id") == a).first()["error_truncated"] is False


def test_detail_with_hints_and_missing(spark, make):
    activity, edges, logs, (a, b, far, double) = tables(make)
    ids = spark.createDataFrame(
        [(a, at("2024-01-14T00:00:00")), (far, at("2024-01-12T00:00:00")), (b, None), ("nobody", None)],
        "activity_id string, created_on timestamp_ntz",
    )
    rows = {r["id"]: r for r in op.activity_get(activity, edges, logs, ids).collect()}
    assert set(rows) == {far, b} and rows[b]["output_count"] == 2 and rows[b]["input_count"] == 1
    assert values(op.missing_ids(activity, ids)) == sorted([(a,), ("nobody",)])
    near = spark.createDataFrame([(a, at("2024-01-11T12:00:00"))], "activity_id string, created_on timestamp_ntz")
    assert op.activity_get(activity, edges, logs, near).first()["input_count"] == 3


def test_batch_equals_single(spark, make):
    activity, edges, logs, ids = tables(make)
    every = op.activity_get(activity, edges, logs).drop("parameters", "metrics")
    for one in (*ids, "legacy"):
        alone = op.activity_get(activity, edges, logs, spark.createDataFrame([(one,)], "activity_id string"))
        assert values(alone.drop("parameters", "metrics")) == values(every.where(F.col("id") == one))
