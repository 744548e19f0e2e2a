"""Lists of runs, newest first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from runlens.functions import contains_ci
from runlens.operators.shapes import after_cursor, by_time, enough_newest, page, run_summary
from runlens.plans import Limits, clamp_limit, in_window, is_blank, resolve_window
from runlens.plans.arguments import DEFAULT_LIMITS, LIST_DAYS, Time


def _equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if not is_blank(value):
            df = df.where(F.col(column) == value)
    return df


def recent_failures(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    application: str | None = None,
    activity_key: str | None = None,
    limit: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    now: datetime | None = None,
) -> DataFrame:
    """Newest failed or canceled runs; skipped runs are not failures.

    ``has_more`` says on every row whether the limit left failures out.
    """
    lo, hi = resolve_window(since, until, LIST_DAYS, now)
    failures = in_window(activity, "activity", lo, hi).where(F.col("status").isin("failed", "canceled"))
    failures = _equals(failures, application=application, activity_key=activity_key)
    size = clamp_limit(limit, 25, limits.max_activities)
    failures = enough_newest(failures, "activity", lo, hi, size + 1)
    order = by_time("created_on", descending=True)
    # One row more than asked for tells; the windows see no more than those.
    fetched = failures.orderBy(*order).limit(size + 1)
    numbered = fetched.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    numbered = numbered.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    rows = numbered.where(F.col("_row") <= size)
    return rows.select(*run_summary(limits.text_chars, with_error=True), "has_more")


def activities_list(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    application: str | None = None,
    environment: str | None = None,
    activity_type: str | None = None,
    activity_key: str | None = None,
    status: str | None = None,
    target_contains: str | None = None,
    limit: int | None = None,
    cursor: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    now: datetime | None = None,
) -> DataFrame:
    """One page of runs. A malformed cursor is ignored and gives the first page."""
    lo, hi = resolve_window(since, until, LIST_DAYS, now)
    runs = _equals(
        in_window(activity, "activity", lo, hi),
        application=application,
        environment=environment,
        activity_type=activity_type,
        activity_key=activity_key,
        status=status,
    )
    if not is_blank(target_contains):
        runs = runs.where(contains_ci(F.col("target"), target_contains))
    if not is_blank(cursor):
        runs = runs.where(after_cursor("created_on", F.lit(cursor), descending=True))
    size = clamp_limit(limit, 50, limits.max_activities)
    runs = enough_newest(runs, "activity", lo, hi, size + 1, cursor)
    return page(runs, "created_on", run_summary(with_error=False), size, descending=True)
