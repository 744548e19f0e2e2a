from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.plans import HISTORY_CAP_NOTE, Limits
from tests.conftest import at, uuid7, values

DAY = {"since": "2024-01-01", "until": "2024-02-01"}


def run(i, app="a", status="succeeded", created="2024-01-10T00:00:00", **more):
    return {"id": uuid7(created, i), "created_on": at(created), "application": app, "status": status, **more}


def test_window_is_half_open(make):
    runs = make("activity", *[run(i, created=c) for i, c in enumerate(["2024-01-01", "2024-01-31T23:59:59.999999", "2024-02-01", "2023-12-31T23:59:59.999999"])])
    assert op.fleet_overview(runs, **DAY).first()["runs"] == 2
    assert op.fleet_overview(runs, since="2024-01-01", until="2024-01-01").count() == 0


def test_overview_counts_and_averages(make):
    t = at("2024-01-10")
    us = timedelta(microseconds=1)
    runs = make(
        "activity",
        run(1, started_on=t, completed_on=t + 1500 * us, records_impacted=5),
        run(2, status="failed", created="2024-01-11T00:00:00", started_on=t, completed_on=t + 3500 * us),
        run(3, status="skipped", created="2024-01-12T00:00:00"),
        run(4, status=None),
        run(5, app=None, status=None),
        run(6, app="", status="running"),
        run(7, app="x", status="skipped"),
    )
    rows = {r["application"]: r for r in op.fleet_overview(runs, **DAY).collect()}
    a = rows["a"]
    assert (a["runs"], a["succeeded"], a["failed"], a["canceled"], a["running"], a["skipped"]) == (4, 1, 1, 0, 0, 1)
    # The mean of 1.5 ms and 3.5 ms is 2.5 ms, which rounds to the even 2.
    assert a["avg_duration_ms"] == 2 and a["success_rate"] == 0.5 and a["p95_duration_ms"] is None
    assert a["total_records_impacted"] == 5
    assert a["last_run_utc"] == "2024-01-12T00:00:00.000000Z"
    assert a["last_failure_utc"] == "2024-01-11T00:00:00.000000Z"
    none = rows[None]
    assert (none["runs"], none["succeeded"], none["success_rate"], none["total_records_impacted"]) == (1, 0, None, None)
    assert rows["x"]["success_rate"] is None and set(rows) == {"a", None, "", "x"}


def test_overview_by_type_and_filter(make):
    runs = make("activity", run(1, activity_type="t1"), run(2, activity_type=None), run(3, app="b", activity_type="t1"))
    by_type = op.fleet_overview(runs, group_by="Application_Type", **DAY)
    assert values(by_type, "application", "activity_type", "runs") == [("a", "t1", 1), ("a", None, 1), ("b", "t1", 1)]
    assert values(op.fleet_overview(runs, application="b", group_by="nonsense", **DAY), "application", "activity_type") == [("b", None)]
    assert op.fleet_overview(runs, application=" ", **DAY).count() == 2


def test_catalog_shares_keys_of_null_and_empty(make):
    runs = make(
        "activity",
        *[run(i, app=None, activity_key="k1", activity_type=" t2 ") for i in range(3)],
        *[run(10 + i, app="", activity_key="k1", activity_type="t1") for i in range(2)],
        run(20, app="", activity_key="k2", activity_type=" "),
        run(21, app="b", activity_type="t1,t2"),
    )
    rows = {r["application"]: r for r in op.catalog(runs, **DAY).collect()}
    assert rows[None]["activity_keys"] == rows[""]["activity_keys"] == ["k1", "k1", "k2"]
    assert rows[None]["activity_types"] == ["t2"] and rows[""]["activity_types"] == ["t1"]
    assert rows[None]["run_count"] == 3 and rows[""]["run_count"] == 3
    assert rows["b"]["activity_keys"] == [] and rows["b"]["activity_types"] == ["t1,t2"]


def test_catalog_ties_go_by_key(make):
    rows = [run(i, activity_key=f"k{i:02d}") for i in range(12)] + [run(50, activity_key="k11")]
    keys = op.catalog(make("activity", *rows), **DAY).first()["activity_keys"]
    assert keys == ["k11"] + [f"k{i:02d}" for i in range(9)]
    assert op.catalog(make("activity", *rows), top=1, **DAY).first()["activity_keys"] == ["k11"]


def test_recent_failures(make):
    runs = make(
        "activity",
        run(1, status="failed", error="x" * 501, created="2024-01-03T00:00:00"),
        run(2, status="canceled", created="2024-01-04T00:00:00", error="y" * 500),
        run(3, status="failed", created="2024-01-04T00:00:00", activity_key="k"),
        run(4, status="skipped"),
        run(5),
    )
    rows = op.recent_failures(runs, **DAY).collect()
    assert [r["id"][-1] for r in rows] == ["3", "2", "1"]
    assert [(len(r["error"] or ""), r["error_truncated"]) for r in rows] == [(0, None), (500, False), (500, True)]
    assert [r["id"][-1] for r in op.recent_failures(runs, limit=0, **DAY).collect()] == ["3"]
    assert op.recent_failures(runs, activity_key="k", **DAY).count() == 1
    assert op.recent_failures(runs, limits=Limits(max_activities=2), limit=99, **DAY).count() == 2


def test_pages_joined_are_the_whole_list(make):
    # Many runs of one instant, so that only the id tells them apart.
    rows = [run(i, created="2024-01-10T00:00:00" if i % 3 else f"2024-01-{1 + i % 28:02d}T00:00:00") for i in range(1, 48)]
    runs = make("activity", *rows)
    whole = [r["id"] for r in op.activities_list(runs, limit=100, **DAY).collect()]
    assert len(whole) == 47
    seen, cursor, pages = [], None, 0
    while pages < 20:
        page = sorted(op.activities_list(runs, limit=10, cursor=cursor, **DAY).collect(), key=lambda r: r["position"])
        seen += [r["id"] for r in page]
        assert all(r["next_cursor"] is None for r in page[:-1])
        cursor, pages = page[-1]["next_cursor"], pages + 1
        if cursor is None:
            break
    assert seen == whole and pages == 5


def test_full_last_page_has_no_cursor(make):
    runs = make("activity", *[run(i) for i in range(10)])
    assert op.activities_list(runs, limit=10, **DAY).where("next_cursor IS NOT NULL").count() == 0


def test_malformed_cursor_gives_the_first_page(make):
    runs = make("activity", *[run(i) for i in range(5)])
    first = values(op.activities_list(runs, limit=2, **DAY), "id")
    assert values(op.activities_list(runs, limit=2, cursor="not-base64-!!", **DAY), "id") == first


def test_list_filters(make):
    runs = make(
        "activity",
        run(1, target="50%_done!", environment="prod", activity_type="t", activity_key="k"),
        run(2, target="50 done", environment="PROD"),
        run(3, target=None, status="failed"),
    )

    def found(**how):
        return [r["id"][-1] for r in op.activities_list(runs, **how, **DAY).collect()]

    assert found(target_contains="%_D") == ["1"] and found(target_contains="done") == ["2", "1"]
    assert found(environment="prod") == ["1"] and found(status="failed") == ["3"] and found(status=" ") == ["3", "2", "1"]
    assert found(activity_type="t", activity_key="k", application="a") == ["1"] and found(application="b") == []


def test_paged_result_and_json(make):
    runs = make("activity", *[run(i, target="t") for i in range(3)])
    page = op.activities_list(runs, limit=2, **DAY)
    row = op.paged_result(page, note="n").first()
    assert [i["id"][-1] for i in row["items"]] == ["2", "1"] and row["next_cursor"] and row["note"] == "n"
    text = op.to_json(op.paged_result(page)).first()["json"]
    assert '"target":"t"' in text and "error" not in text and "note" not in text and ": " not in text


def test_history_covers_the_latest_runs_only(make):
    t = at("2024-01-10")
    ms = timedelta(milliseconds=1)
    rows = [
        run(i, activity_key="k", created=f"2024-01-{i + 1:02d}T00:00:00", started_on=t, completed_on=t + i * ms, records_impacted=i)
        for i in range(25)
    ]
    stats = op.history_stats(make("activity", *rows), activity_key="k", limit=11, **DAY).first()
    assert stats["count"] == 11
    assert (stats["min_duration_ms"], stats["max_duration_ms"], stats["avg_duration_ms"]) == (14, 24, 19)
    # Ranks 0..10 of 14..24 at 0.95 give 23.5, which rounds to the even 24.
    assert stats["p95_duration_ms"] == 24 and stats["avg_records_impacted"] == 19


def test_history_statistics(make):
    def stats(*statuses):
        rows = [run(i, status=s, activity_key="k") for i, s in enumerate(statuses)]
        return op.history_stats(make("activity", *rows), activity_key="k", **DAY).first()

    s = stats("succeeded", "succeeded", "failed", "skipped", "skipped")
    assert (s["count"], s["skipped"], s["success_rate"], s["p95_duration_ms"]) == (5, 2, 0.6667, None)
    s = stats("skipped", "skipped")
    assert (s["count"], s["skipped"], s["success_rate"]) == (2, 2, None)


def test_history_averages_rounded_durations(make):
    t = at("2024-01-10")
    us = timedelta(microseconds=1)
    rows = [run(i, activity_key="k", started_on=t, completed_on=t + d * us) for i, d in enumerate([500, 1500, 2400])]
    # 0, 2 and 2 ms after rounding each; the unrounded mean would give 1 ms as well as the sum 4.4.
    s = op.history_stats(make("activity", *rows), activity_key="k", **DAY).first()
    assert (s["min_duration_ms"], s["avg_duration_ms"], s["max_duration_ms"]) == (0, 1, 2)


def test_history_of_an_empty_window(make):
    s = op.history_stats(make("activity", run(1)), activity_key="none", **DAY).first()
    assert s["count"] == 0 and s["success_rate"] is None and s["p95_duration_ms"] is None


def test_history_batch_equals_single(make):
    rows = [run(i, app="ab"[i % 2], activity_key=f"k{i % 3}", created=f"2024-01-{1 + i % 28:02d}T00:00:00") for i in range(60)]
    runs = make("activity", *rows, run(99, activity_key=None))
    batch = op.history_runs(runs, by=["application", "activity_key"], limit=4, **DAY)
    assert batch.select("application", "activity_key").distinct().count() == 6
    single = op.history_runs(runs, application="a", activity_key="k1", limit=4, **DAY)
    assert values(single) == values(batch.where("application = 'a' AND activity_key = 'k1'"))
    stats = op.history_stats(runs, by=["application", "activity_key"], limit=4, **DAY)
    alone = op.history_stats(runs, application="a", activity_key="k1", limit=4, **DAY)
    assert values(alone) == values(stats.where("application = 'a' AND activity_key = 'k1'").drop("application", "activity_key"))


def test_history_result_and_cap(make):
    runs = make("activity", run(1, activity_type="t", error="e" * 600, status="failed"), run(2, activity_type="t"))
    row = op.activity_history(runs, activity_type="t", since="2020-01-01", until="2024-02-01").first()
    assert [r["id"][-1] for r in row["runs"]] == ["2", "1"] and row["note"] == HISTORY_CAP_NOTE
    assert row["runs"][1]["error_truncated"] and row["stats"]["count"] == 2
    assert op.activity_history(runs, activity_type="t", **DAY).first()["note"] is None
    with pytest.raises(ValueError, match="name a key or a type"):
        op.history_runs(runs, application="a", **DAY)
    with pytest.raises(ValueError, match="no workload columns"):
        op.history_runs(runs, by=["host"], activity_key="k", **DAY)


def test_retention_and_id_audit(make):
    now = at("2024-06-01")
    runs = make(
        "activity",
        run(1, created="2024-01-10T00:00:00"),
        {**run(2), "id": "legacy"},
        {**run(3, created="2024-01-20T00:00:00"), "id": uuid7("2024-01-10T00:00:00")},
    )
    audit = op.id_time_audit(runs).first()
    assert (audit["runs"], audit["undecodable"], audit["outside_bracket"], audit["max_drift_ms"]) == (3, 1, 1, 864000000)
    rows = op.retention_coverage(runs, now=now).collect()
    assert rows[0]["log_from_utc"] == "2024-01-09T00:00:00.000000Z" and all(r["note"] for r in rows)


def test_readonly_query(spark, make):
    runs = make("activity", *[run(i, app=f"a{i}") for i in range(5)])
    how = {"tables": {"activity": runs}}
    rows = op.run_readonly_query(spark, "SELECT application FROM activity ORDER BY application DESC;", max_rows=3, **how).collect()
    assert [tuple(r) for r in rows] == [("a4", True), ("a3", True), ("a2", True)]
    exact = op.run_readonly_query(spark, "WITH x AS (SELECT 1 AS n) SELECT count(*) AS `a b` FROM activity, x", max_rows=1, **how)
    assert exact.columns == ["a b", "truncated"] and tuple(exact.first()) == (5, False)
    assert op.run_readonly_query(spark, "SELECT * FROM activity WHERE false", **how).count() == 0
    with pytest.raises(ValueError, match="Disallowed keyword in query: DROP"):
        op.run_readonly_query(spark, "SELECT 1 AS drop", **how)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_page_manifest_equals_paging(make, size, descending):
    rows = [run(i, created="2024-01-10T00:00:00" if i % 2 else f"2024-01-{1 + i % 28:02d}T00:00:00") for i in range(50)]
    runs = make("activity", *rows).repartition(5)
    order = sorted([(r["created_on"], r["id"]) for r in rows], reverse=descending)
    pages = sorted(op.page_manifest(runs, "created_on", size, descending=descending, partitions=4).collect(), key=lambda r: r["page"])
    chunks = [order[i : i + size] for i in range(0, len(order), size)]
    assert [r["page"] for r in pages] == list(range(1, len(chunks) + 1))
    assert [r["row_count"] for r in pages] == [len(c) for c in chunks]
    assert [r["last_id"] for r in pages] == [c[-1][1] for c in chunks]
    assert [r["next_cursor"] is None for r in pages] == [False] * (len(chunks) - 1) + [True]
    if descending and size == 7:
        second = op.activities_list(runs, limit=7, cursor=pages[0]["next_cursor"], **DAY).collect()
        assert [r["id"] for r in second] == [i for _, i in chunks[1]]


def test_page_manifest_of_nothing(make):
    runs = make("activity", run(1)).where(F.lit(False))
    assert op.page_manifest(runs, "created_on", 10).count() == 0
