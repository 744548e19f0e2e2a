from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.functions.times import STALE_NOTE
from runlens.plans import Limits
from tests.conftest import at, uuid7, values

CREATED = "2024-01-10T00:00:00"
RUN = uuid7(CREATED, 1)
NOW = at("2024-01-20T00:00:00")
LATE = at("2024-12-01T00:00:00")


def line(i, time, run=RUN, level=2, **more):
    return {"id": i, "event_time_utc": at(time), "log_level": level, "activity_id": run, **more}


@pytest.fixture(scope="module")
def logs(make):
    return make(
        "log_entries",
        line(1, "2024-01-08T00:00:00", level=0, category="b"),
        line(2, "2024-01-10T00:00:01", level=6, category="a", message="m2"),
        line(3, "2024-01-10T00:00:01", level=99, category=None),
        line(4, "2024-01-11T23:59:59.999999", level=4, category="b", exception_type="E", message="z"),
        line(5, "2024-01-12T00:00:00", level=4, exception_type="E"),
        line(6, "2024-01-07T23:59:59.999999", level=4),
        line(7, "2020-01-01T00:00:00", run="legacy", level=5, exception_type="F", message="y" * 600),
        line(8, "2024-01-10T00:00:00", run="", level=3),
        line(9, "2024-01-10T00:00:00", run=None, level=3),
        line(10, "2024-01-10T00:00:02", level=4, category="b", exception_type="E", message="x" * 600),
    )


def test_summary_window_and_levels(logs):
    rows = {r["activity_id"]: r for r in op.log_summary_stats(logs, now=NOW).collect()}
    assert set(rows) == {RUN, "legacy"}
    r = rows[RUN]
    # Levels 6 and 99 count in the total only; the line of 12 January is outside.
    assert (r["total"], r["trace"], r["debug"], r["error"], r["critical"]) == (5, 1, None, 2, None)
    assert r["first_event_utc"] == "2024-01-08T00:00:00.000000Z"
    assert r["last_event_utc"] == "2024-01-11T23:59:59.999999Z" and r["note"] is None
    assert rows["legacy"]["total"] == 1 and rows["legacy"]["note"] is None
    late = {r["activity_id"]: r["note"] for r in op.log_summary_stats(logs, now=LATE).collect()}
    assert late == {RUN: STALE_NOTE, "legacy": None}


def test_summary_of_asked_runs(spark, logs):
    absent = uuid7("2024-01-01T00:00:00", 9)
    ids = spark.createDataFrame([(RUN,), (absent,)], "activity_id string")
    rows = {r["activity_id"]: r["total"] for r in op.log_summary_stats(logs, ids, now=NOW).collect()}
    assert rows == {RUN: 5, absent: 0}
    hinted = spark.createDataFrame(
        [(RUN, at("2024-01-14T00:00:00")), ("legacy", None), (absent, None)], "activity_id string, created_on timestamp_ntz"
    )
    rows = {r["activity_id"]: r["total"] for r in op.log_summary_stats(logs, hinted, now=NOW).collect()}
    assert rows == {RUN: 1, "legacy": 1, absent: 0}


def test_summary_batch_equals_single(spark, logs):
    every = op.activity_log_summary(logs, now=NOW)
    for run in (RUN, "legacy"):
        one = spark.createDataFrame([(run,)], "activity_id string")
        assert values(op.activity_log_summary(logs, one, now=NOW)) == values(every.where(F.col("activity_id") == run))


def test_whole_summary(logs):
    r = op.activity_log_summary(logs, now=NOW).where(F.col("activity_id") == RUN).first()
    assert r["total"] == 5 and r["counts_by_level"]["error"] == 2 and r["counts_by_level"]["debug"] is None
    assert [tuple(c) for c in r["top_categories"]] == [("b", 3), (None, 1), ("a", 1)]
    assert [tuple(e) for e in r["exception_types"]] == [("E", 2, "x" * 500, True)]
    only = op.activity_log_summary(logs, top=1, now=NOW).where(F.col("activity_id") == RUN).first()
    assert [c["category"] for c in only["top_categories"]] == ["b"] and only["total"] == 5


def test_top_categories_break_ties_by_name(make):
    lines = [line(i, CREATED, category=f"c{i % 12:02d}") for i in range(24)] + [line(99, CREATED, category=None)] * 2
    rows = op.log_summary_categories(make("log_entries", *lines)).orderBy("rank").collect()
    assert [r["category"] for r in rows] == [None] + [f"c{i:02d}" for i in range(9)]


def test_smallest_message_survives_the_cut(make):
    texts = ["b", "a" * 499 + "z", "a" * 500 + "1", "a" * 500 + "0", None]
    lines = [line(i, CREATED, level=4, exception_type="E", message=t) for i, t in enumerate(texts)]
    row = op.log_summary_exceptions(make("log_entries", *lines)).first()
    assert row["sample_message"] == min(t for t in texts if t)[:500] and row["count"] == 5
    whole = op.log_summary_exceptions(make("log_entries", *lines), limits=Limits(text_chars=0)).first()
    assert whole["sample_message"] == "a" * 500 + "0"


def ids_of(df):
    return [r["id"] for r in sorted(df.collect(), key=lambda r: (r["activity_id"], r["position"]))]


def test_lines_window_by_id_is_one_day(logs):
    mine = op.activity_logs(logs, min_level="Trace", now=NOW).where(F.col("activity_id") == RUN)
    assert ids_of(mine) == [2, 3, 10]


def test_lines_of_an_undated_run_use_the_horizon(make):
    logs = make("log_entries", line(1, "2024-01-01T00:00:00", run="legacy"), line(2, "2023-10-22T00:00:00", run="legacy"),
                line(3, "2023-10-21T23:59:59", run="legacy"), line(4, "2024-01-21T00:00:00", run="legacy"))
    assert ids_of(op.activity_logs(logs, now=NOW)) == [2, 1]


def test_lines_window_by_hints(spark, logs):
    def found(**hints):
        cols = ", ".join(f"{k} timestamp_ntz" for k in hints)
        runs = spark.createDataFrame([(RUN, *[at(v) for v in hints.values()])], f"activity_id string, {cols}")
        return ids_of(op.activity_logs(logs, runs, min_level="Trace", now=NOW))

    assert found(started_on="2024-01-09T00:00:00", completed_on="2024-01-12T00:00:00") == [1, 2, 3, 10, 4, 5]
    assert found(created_on="2024-01-08T00:00:00") == [6, 1]
    assert found(completed_on="2024-01-11T00:00:00") == [2, 3, 10, 4]


def test_line_filters(logs):
    def found(**how):
        return ids_of(op.activity_logs(logs, now=NOW, **how).where(F.col("activity_id") == RUN))

    assert found() == [2, 3, 10] and found(min_level="none") == [2, 3]
    assert found(exceptions_only=True) == [10] and found(category_contains="B") == [10]
    assert found(message_contains="M2") == [2] and found(order="DESC") == [10, 3, 2] and found(order="up") == [2, 3, 10]


def test_line_shape(logs):
    r = op.activity_logs(logs, now=LATE).where("id = 10").first()
    assert (r["level"], len(r["message"]), r["message_truncated"], r["exception_truncated"]) == ("Error", 500, True, None)
    assert r["note"] == STALE_NOTE
    assert len(op.activity_logs(logs, full=True, now=NOW).where("id = 10").first()["message"]) == 600


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_of_every_run_joined_are_all_lines(make, order):
    runs = [uuid7(CREATED, n) for n in range(3)]
    lines = [line(i, "2024-01-10T00:00:00" if i % 4 else f"2024-01-10T00:{i:02d}:00", run=runs[i % 3]) for i in range(40)]
    logs = make("log_entries", *lines)
    whole = ids_of(op.activity_logs(logs, order=order, now=NOW))
    got, cursors, pages = {}, None, 0
    while pages < 10:
        page = op.activity_logs(logs, cursors, limit=5, order=order, now=NOW)
        rows = sorted(page.collect(), key=lambda r: (r["activity_id"], r["position"]))
        for r in rows:
            got.setdefault(r["activity_id"], []).append(r["id"])
        more = [(r["activity_id"], r["next_cursor"]) for r in rows if r["next_cursor"]]
        pages += 1
        if not more:
            break
        cursors = logs.sparkSession.createDataFrame(more, "activity_id string, cursor string")
    assert [i for r in sorted(got) for i in got[r]] == whole and pages == 3


def test_log_cursor_with_a_text_id_is_ignored(spark, logs):
    import base64

    bad = base64.b64encode(b"638405280000000000|abc").decode()
    runs = spark.createDataFrame([(RUN, bad)], "activity_id string, cursor string")
    assert ids_of(op.activity_logs(logs, runs, now=NOW)) == [2, 3, 10]


def test_search(logs):
    window = {"since": "2024-01-08", "until": "2024-01-12"}

    def found(**how):
        return [r["id"] for r in op.logs_search(logs, **window, **how).collect()]

    assert found() == [4, 10, 3, 2, 9, 8]
    assert found(min_level="Trace") == [4, 10, 3, 2, 9, 8, 1]
    assert found(exception_type="E", limit=1) == [4] and found(application="x") == []
    first = op.logs_search(logs, limit=2, **window).collect()
    assert found(cursor=first[-1]["next_cursor"]) == [3, 2, 9, 8]
    assert "note" not in op.logs_search(logs, **window).columns
    default = op.logs_search(logs, now=at("2024-01-11T00:00:00"))
    assert sorted(r["id"] for r in default.collect()) == [2, 3, 8, 9, 10]
