from __future__ import annotations

from runlens.operators import fleet_overview
from runlens.schema import ACTIVITY, LOG_ENTRIES
from runlens.sources import testdata
from runlens.streaming import FleetState, LatestRuns, level_counts_by_window
from tests.conftest import SF_DIR, at, values

WINDOW = {"since": "1995-01-01", "until": "2002-01-01"}


def streamed(spark, path, checkpoint, name, mode="append", **how):
    logs = spark.readStream.schema(LOG_ENTRIES).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        level_counts_by_window(logs, **how)
        .writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    logs = testdata.log_entries(spark, SF_DIR, text=False)
    path = str(tmp_path / "logs")
    logs.repartitionByRange(3, "event_time_utc").write.parquet(path)
    got = streamed(spark, path, str(tmp_path / "cp"), "all_windows", mode="complete", window="30 days")
    assert values(got) == values(level_counts_by_window(logs, window="30 days"))


def test_late_lines_are_ignored(spark, make, tmp_path):
    def line(i, time):
        return {"id": i, "event_time_utc": at(time), "log_level": 2, "application": "a"}

    path = str(tmp_path / "logs")
    for batch in (
        [line(1, "2024-01-01T00:10:00"), line(2, "2024-01-01T00:50:00")],
        [line(3, "2024-01-01T00:55:00"), line(4, "2024-01-01T03:00:00")],
        # A batch is checked against the watermark that held one batch before.
        [line(7, "2024-01-01T04:00:00")],
        [line(5, "2024-01-01T00:20:00"), line(6, "2024-01-01T05:00:00")],
        [line(8, "2024-01-01T06:00:00")],
    ):
        make("log_entries", *batch).coalesce(1).write.mode("append").parquet(path)
    got = streamed(spark, path, str(tmp_path / "cp"), "late", window="1 hour", lateness="10 minutes")
    rows = {r["from_utc"]: r["total"] for r in got.collect()}
    assert rows["2024-01-01T00:00:00.000000Z"] == 3 and rows["2024-01-01T03:00:00.000000Z"] == 1


def test_a_stream_of_runs_keeps_the_overview(spark, tmp_path):
    runs = testdata.activity(spark, SF_DIR, text=False)
    path = str(tmp_path / "runs")
    runs.repartitionByRange(3, "created_on").write.parquet(path)
    state = FleetState(spark, str(tmp_path / "state"))
    seen = []

    def fold(batch, number):
        seen.append(number)
        state.fold(batch, number)
        if number == 1:
            state.fold(batch, number)  # sent again
        if number == 0:
            state.compact()
            state.fold(batch, number)  # sent again after it was added up

    query = (
        spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(fold)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None and seen == [0, 1, 2]
    for how in ({}, {"group_by": "application_type"}, {"application": "app0"}):
        assert values(state.overview(**WINDOW, **how)) == values(fleet_overview(runs, **WINDOW, **how))
    state.compact()
    state.compact()
    year = {"since": "1999-01-01", "until": "2000-01-01"}
    assert values(FleetState(spark, str(tmp_path / "state")).overview(**year)) == values(fleet_overview(runs, **year))


def test_a_batch_that_failed_half_way_counts_once(spark, make, tmp_path):
    def runs(*keys):
        return make("activity", *[{"id": k, "created_on": at("2024-01-01T05:00:00"), "application": "a", "status": "succeeded"} for k in keys])

    state = FleetState(spark, str(tmp_path / "state"))
    assert state.overview().count() == 0
    state.fold(runs("x"), 0)  # some of the rows, before the writer was lost
    state.fold(runs("x", "y"), 0)
    state.fold(runs(), 1)
    assert state.overview().first()["runs"] == 2
    state.compact()
    state.fold(runs("x", "y"), 0)
    state.fold(runs("z"), 2)
    assert state.overview().first()["runs"] == 3


def _run(key, time, status):
    return {"id": key, "created_on": at(time), "status": status}


def test_a_stream_of_runs_keeps_the_newest_rows(spark, make, tmp_path):
    path = str(tmp_path / "runs")
    for batch in (
        [_run("a", "2024-01-01T00:00:00", "pending"), _run("b", "2024-01-01T01:00:00", "running"), _run("a", "2024-01-01T02:00:00", "succeeded")],
        [_run("b", "2024-01-02T00:00:00", "failed"), _run("c", "2024-01-10T00:00:00", "running")],
        # Two days before the newest row so far is the limit: the first is late, the others are not.
        [_run("a", "2024-01-07T23:59:59", "too late"), _run("c", "2024-01-09T00:00:00", "older"), _run("d", "2024-01-08T00:00:00", "running")],
        [_run("a", "2024-01-11T00:00:00", "returned")],
    ):
        make("activity", *batch).coalesce(1).write.mode("append").parquet(path)
    state = LatestRuns(spark, str(tmp_path / "state"), lateness_days=2)

    def fold(batch, number):
        state.fold(batch, number)
        state.fold(batch, number)  # sent again

    query = (
        spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", 1).parquet(path).writeStream.foreachBatch(fold)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    newest = [("a", "returned"), ("b", "failed"), ("c", "running"), ("d", "running")]
    assert values(state.latest(), "id", "status") == newest
    assert values(state.late(), "id", "status", "batch") == [("a", "too late", 2)]
    # What travels on is no more than two days of runs; final rows are left behind.
    assert values(state._open()[0], "id") == [("a",), ("c",), ("d",)]
    assert values(state._kept("final"), "id", "status") == [("a", "succeeded"), ("b", "failed")]
    state.fold(make("activity"), 4)
    assert values(LatestRuns(spark, str(tmp_path / "state")).latest(), "id", "status") == newest


def test_nothing_has_come_yet(spark, make, tmp_path):
    state = LatestRuns(spark, str(tmp_path / "state"))
    assert state.latest().count() == 0 and state.late().count() == 0
    state.fold(make("activity"), 0)
    state.fold(make("activity", _run("a", "2024-01-01T00:00:00", "x")).drop("host"), 1)
    assert values(state.latest(), "id", "status", "host") == [("a", "x", None)]
