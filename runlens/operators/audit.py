"""Checks on the time rules the other operators rely on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from runlens.functions import (
    bracket,
    canonical_id,
    duration_ms,
    iso8601_utc,
    log_window,
    retention_note,
    uuid7_time,
)
from runlens.plans import utc_now

BRACKET_DAYS = 2


def id_time_audit(activity: DataFrame) -> DataFrame:
    """Per application: how far the times inside ids are from creation times.

    A run with ``outside_bracket`` is one a lookup by id alone does not find;
    one with an ``undecodable`` id is looked for without a time bound.
    """
    id_time, created = uuid7_time(F.col("id")), F.col("created_on")
    runs = activity.select("application", "created_on", id_time.alias("id_time"))
    lo, hi = bracket(F.col("id_time"), BRACKET_DAYS)
    drift = F.abs(duration_ms(F.col("id_time"), created))
    return runs.groupBy("application").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("id_time").isNull()).alias("undecodable"),
        F.count_if((created < lo) | (created >= hi)).alias("outside_bracket"),
        F.max(drift).alias("max_drift_ms"),
    )


def retention_coverage(activity: DataFrame, *, now: datetime | None = None) -> DataFrame:
    """Per run: the window its log lines are looked for in, and whether they may be gone."""
    now = now or utc_now()
    c = F.col
    lo, hi = log_window(
        id_time=uuid7_time(c("id")),
        created=c("created_on"),
        started=c("started_on"),
        completed=c("completed_on"),
        now=now,
    )
    windows = activity.select(canonical_id(c("id")).alias("activity_id"), "application", lo.alias("lo"), hi.alias("hi"))
    return windows.select(
        "activity_id",
        "application",
        iso8601_utc(c("lo")).alias("log_from_utc"),
        iso8601_utc(c("hi")).alias("log_until_utc"),
        retention_note(c("hi"), now).alias("note"),
    )
