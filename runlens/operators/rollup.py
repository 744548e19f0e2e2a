"""Catalog of applications and fleet health."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.functions import half_even, iso8601_utc, micros_between, success_rate
from runlens.operators.shapes import or_empty
from runlens.plans import in_window, is_blank, resolve_window
from runlens.plans.arguments import CATALOG_DAYS, OVERVIEW_DAYS, Time

TOP_KEYS = 10


def _top_keys(runs: DataFrame, top: int) -> DataFrame:
    """The most frequent keys per application; null and empty share one list.

    Ties go by key, then the null application first.
    """
    counted = (
        runs.where(F.col("activity_key").isNotNull())
        .groupBy("application", "activity_key")
        .agg(F.count(F.lit(1)).alias("run_count"))
        .withColumn("app", or_empty(F.col("application")))
    )
    order = Window.partitionBy("app").orderBy(
        F.desc("run_count"), F.asc("activity_key"), F.asc_nulls_first("application")
    )
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def catalog_keys(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    top: int = TOP_KEYS,
    now: datetime | None = None,
) -> DataFrame:
    """The ranked keys behind :func:`catalog`, one row each."""
    lo, hi = resolve_window(since, until, CATALOG_DAYS, now)
    return _top_keys(in_window(activity, "activity", lo, hi), top).select(
        F.col("app").alias("application"), "rank", "activity_key", "run_count"
    )


def catalog(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    top: int = TOP_KEYS,
    now: datetime | None = None,
) -> DataFrame:
    """Footprint of each application: types, top keys, run count, first and last run.

    Runs are reduced to distinct types and to counts per key before they are
    shuffled, and each task passes on ``top`` keys per application at most, so
    an application with most of the runs costs no more than the others. Types
    are collected after they were made distinct; an application has as many
    as it has kinds of work, and the row names them all.
    """
    lo, hi = resolve_window(since, until, CATALOG_DAYS, now)
    runs = in_window(activity, "activity", lo, hi)
    kind = F.nullif(F.trim(F.col("activity_type")), F.lit(""))
    # Distinct types come first, with partial counts; one row of each then makes the list.
    by_type = runs.groupBy("application", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_on").alias("first"), F.max("created_on").alias("last")
    )
    footprint = by_type.groupBy("application").agg(
        F.sort_array(F.collect_list("kind")).alias("activity_types"),
        F.sum("n").alias("run_count"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
    )
    keys = (
        _top_keys(runs, top)
        .groupBy("app")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "activity_key"))).alias("ranked"))
    )
    return footprint.join(keys, or_empty(F.col("application")) == F.col("app"), "left").select(
        "application",
        "activity_types",
        F.coalesce(
            F.transform("ranked", lambda x: x["activity_key"]), F.array().cast("array<string>")
        ).alias("activity_keys"),
        "run_count",
        iso8601_utc(F.col("first_seen")).alias("first_seen_utc"),
        iso8601_utc(F.col("last_seen")).alias("last_seen_utc"),
    )


def fleet_overview(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    application: str | None = None,
    group_by: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Health per application, or per application and type.

    The mean duration adds whole microseconds and divides once, so it does not
    depend on how the rows are split. ``p95_duration_ms`` is always null here;
    :func:`~runlens.operators.history.activity_history` has it per workload.
    """
    by_type = (group_by or "").lower() == "application_type"
    keys = ["application", "activity_type"] if by_type else ["application"]
    rows = _in_overview(activity, since, until, application, now).groupBy(*keys).agg(*figures())
    return _with_type(shown_figures(rows, keys))


def fleet_overview_levels(
    activity: DataFrame,
    *,
    since: Time = None,
    until: Time = None,
    application: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Health per application and type, per application, and of the whole fleet, from one scan.

    ``level`` is ``type``, ``application`` or ``fleet`` and tells the totals of
    a level from rows whose application or type is null. Each run is counted
    into its three groups before the shuffle. No runs give no rows, not even a total.
    """
    keys = ["application", "activity_type"]
    runs = _in_overview(activity, since, until, application, now)
    grouped = runs.groupingSets([keys, keys[:1], []], *keys).agg(F.grouping_id().alias("level"), *figures())
    rows = shown_figures(grouped, [*keys, "level"])
    name = F.when(F.col("level") == 0, "type").when(F.col("level") == 1, "application").otherwise("fleet")
    return rows.where(F.col("runs") > 0).withColumn("level", name)


def _in_overview(activity: DataFrame, since: Time, until: Time, application: str | None, now: datetime | None) -> DataFrame:
    lo, hi = resolve_window(since, until, OVERVIEW_DAYS, now)
    runs = in_window(activity, "activity", lo, hi)
    return runs if is_blank(application) else runs.where(F.col("application") == application)


def _with_type(rows: DataFrame) -> DataFrame:
    first, *rest = rows.columns
    if "activity_type" in rest:
        return rows
    return rows.select(first, F.lit(None).cast("string").alias("activity_type"), *rest)


def figures() -> list[Column]:
    """Aggregates of runs that an overview is made of; those of parts add up to those of the whole."""
    status, created = F.col("status"), F.col("created_on")
    micros = micros_between(F.col("started_on"), F.col("completed_on"))

    def counted(value: str):
        return F.count_if(status == value).alias(value)

    return [
        F.count(F.lit(1)).alias("runs"),
        counted("succeeded"),
        counted("failed"),
        counted("canceled"),
        counted("running"),
        counted("skipped"),
        # Microseconds of a large fleet, or its records, exceed 64 bits.
        F.sum(micros.cast("decimal(38,0)")).alias("micros"),
        F.count(micros).alias("timed"),
        F.sum(F.col("records_impacted").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total_records_impacted"),
        F.max("created_on").alias("last_run"),
        F.max(F.when(status.isin("failed", "canceled"), created)).alias("last_failure"),
    ]


def added_figures() -> list[Column]:
    """The :func:`figures` of a whole from those of its parts."""
    wide = ("micros", "total_records_impacted")
    sums = ("runs", "succeeded", "failed", "canceled", "running", "skipped", "timed")
    return [
        *(F.sum(c).alias(c) for c in sums),
        *(F.sum(c).cast("decimal(38,0)").alias(c) for c in wide),
        *(F.max(c).alias(c) for c in ("last_run", "last_failure")),
    ]


def shown_figures(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An overview's columns from its figures."""
    c = F.col
    return rows.select(
        *keys,
        "runs",
        "succeeded",
        "failed",
        "canceled",
        "running",
        "skipped",
        success_rate(c("succeeded"), c("failed"), c("canceled")).alias("success_rate"),
        half_even(c("micros").cast("double") / (F.nullif(c("timed"), F.lit(0).cast("bigint")) * 1000)).alias("avg_duration_ms"),
        F.lit(None).cast("bigint").alias("p95_duration_ms"),
        "total_records_impacted",
        iso8601_utc(c("last_run")).alias("last_run_utc"),
        iso8601_utc(c("last_failure")).alias("last_failure_utc"),
    )
