"""Latest runs of recurring workloads and statistics over them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.functions import duration_ms, half_even, percentile_of_sorted, success_rate
from runlens.operators.shapes import by_time, cut_texts, run_summary
from runlens.plans import Limits, cap_history, clamp_limit, in_window, is_blank, resolve_window
from runlens.plans.arguments import DEFAULT_LIMITS, HISTORY_DAYS, Time

WORKLOAD_COLUMNS = ("application", "activity_type", "activity_key")
STATISTICS = (
    "count",
    "skipped",
    "success_rate",
    "min_duration_ms",
    "avg_duration_ms",
    "p95_duration_ms",
    "max_duration_ms",
    "avg_records_impacted",
)


def _latest(
    activity: DataFrame,
    by: Sequence[str],
    activity_key: str | None,
    activity_type: str | None,
    application: str | None,
    since: Time,
    until: Time,
    limit: int | None,
    limits: Limits,
    now: datetime | None,
) -> tuple[DataFrame, str | None]:
    """The newest runs of each workload, numbered, and the note on the window."""
    unknown = set(by) - set(WORKLOAD_COLUMNS)
    if unknown:
        raise ValueError(f"by: no workload columns: {sorted(unknown)}")
    named = {"activity_key": activity_key, "activity_type": activity_type}
    if all(is_blank(v) and c not in by for c, v in named.items()):
        raise ValueError("activity_key: name a key or a type, or split by one")

    lo, hi = resolve_window(since, until, HISTORY_DAYS, now)
    lo, note = cap_history(lo, hi, limits.activity_retention_days)
    runs = in_window(activity, "activity", lo, hi)
    for column, value in {**named, "application": application}.items():
        if not is_blank(value):
            runs = runs.where(F.col(column) == value)
        elif column in by and column != "application":
            runs = runs.where(F.col(column).isNotNull())

    size = clamp_limit(limit, 30, limits.max_activities)
    order = by_time("created_on", descending=True)
    if not by:
        # A single workload: a top-n, then a window over no more than its rows.
        runs = runs.orderBy(*order).limit(size)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return runs.withColumn("position", position).where(F.col("position") <= size), note


def _noted(note: str | None) -> Column:
    return F.lit(note).cast("string").alias("note")


def history_runs(
    activity: DataFrame,
    *,
    by: Sequence[str] = (),
    activity_key: str | None = None,
    activity_type: str | None = None,
    application: str | None = None,
    since: Time = None,
    until: Time = None,
    limit: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    now: datetime | None = None,
) -> DataFrame:
    """The latest runs of a workload, newest first.

    A workload is named by key, by type or by both. With ``by`` every
    combination of those columns is a workload of its own. The window reaches
    back ``limits.activity_retention_days`` at most; ``note`` says if that cut it.
    """
    cut = cut_texts(activity, limits.text_chars, "error")
    latest, note = _latest(cut, by, activity_key, activity_type, application, since, until, limit, limits, now)
    return latest.select("position", *run_summary(cut=True), _noted(note))


def _statistics() -> list[Column]:
    """Aggregates over the latest runs.

    The durations of a workload are collected, but no more of them than the
    run limit, to interpolate the percentile on exact ranks.
    """
    ms = duration_ms(F.col("started_on"), F.col("completed_on"))
    status = F.col("status")

    def counted(value: str) -> Column:
        return F.count_if(status == value)

    def mean(value: Column) -> Column:
        return half_even(F.sum(value) / F.nullif(F.count(value), F.lit(0).cast("bigint")))

    return [
        F.count(F.lit(1)).alias("count"),
        counted("skipped").alias("skipped"),
        success_rate(counted("succeeded"), counted("failed"), counted("canceled")).alias("success_rate"),
        F.min(ms).alias("min_duration_ms"),
        mean(ms).alias("avg_duration_ms"),
        percentile_of_sorted(F.sort_array(F.collect_list(ms)), 0.95).alias("p95_duration_ms"),
        F.max(ms).alias("max_duration_ms"),
        mean(F.col("records_impacted")).alias("avg_records_impacted"),
    ]


def history_stats(
    activity: DataFrame,
    *,
    by: Sequence[str] = (),
    activity_key: str | None = None,
    activity_type: str | None = None,
    application: str | None = None,
    since: Time = None,
    until: Time = None,
    limit: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    now: datetime | None = None,
) -> DataFrame:
    """Statistics over the runs :func:`history_runs` returns, not over the whole window."""
    latest, note = _latest(activity, by, activity_key, activity_type, application, since, until, limit, limits, now)
    return latest.groupBy(*by).agg(*_statistics()).withColumn("note", _noted(note))


def activity_history(
    activity: DataFrame,
    *,
    by: Sequence[str] = (),
    activity_key: str | None = None,
    activity_type: str | None = None,
    application: str | None = None,
    since: Time = None,
    until: Time = None,
    limit: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    now: datetime | None = None,
) -> DataFrame:
    """One row per workload: ``runs``, ``stats`` and ``note``."""
    cut = cut_texts(activity, limits.text_chars, "error")
    latest, note = _latest(cut, by, activity_key, activity_type, application, since, until, limit, limits, now)
    run = F.struct(*run_summary(cut=True)).alias("run")
    grouped = latest.groupBy(*by).agg(
        *_statistics(), F.array_sort(F.collect_list(F.struct("position", run))).alias("_runs")
    )
    return grouped.select(
        *by,
        F.transform("_runs", lambda x: x["run"]).alias("runs"),
        F.struct(*STATISTICS).alias("stats"),
        _noted(note),
    )
