"""Result rows: how runs and log lines look to a caller, and pages of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.functions import (
    canonical_id,
    cursor_encode,
    cursor_id,
    cursor_time,
    duration_ms,
    humanize,
    iso8601_utc,
    json_column,
    level_name,
    truncate,
    was_truncated,
)
from runlens.plans.windows import in_window
from runlens.schema import MONTH_COLUMN


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def cut_texts(df: DataFrame, chars: int | None, *texts: str) -> DataFrame:
    """Truncate long texts now, so that a shuffle carries no more than is shown.

    The result is read with ``cut=True`` below.
    """
    for text in texts:
        df = df.withColumn(f"{text}_truncated", was_truncated(F.col(text), chars))
        df = df.withColumn(text, truncate(F.col(text), chars))
    return df


def _text(name: str, chars: int | None, cut: bool) -> list[Column]:
    value, flag = F.col(name), f"{name}_truncated"
    if cut:
        return [value, F.col(flag)]
    return [truncate(value, chars).alias(name), was_truncated(value, chars).alias(flag)]


def run_summary(chars: int | None = None, *, with_error: bool = True, cut: bool = False) -> list[Column]:
    """Columns of a run summary. Without errors both error columns are null."""
    c = F.col
    spent = duration_ms(c("started_on"), c("completed_on"))
    if with_error:
        error = _text("error", chars, cut)
    else:
        error = [F.lit(None).cast("string").alias("error"), F.lit(None).cast("boolean").alias("error_truncated")]
    return [
        or_empty(canonical_id(c("id"))).alias("id"),
        iso8601_utc(c("created_on")).alias("created_on_utc"),
        c("application"),
        c("environment"),
        c("activity_type"),
        c("activity_key"),
        c("target"),
        or_empty(c("status")).alias("status"),
        iso8601_utc(c("started_on")).alias("started_on_utc"),
        iso8601_utc(c("completed_on")).alias("completed_on_utc"),
        spent.alias("duration_ms"),
        humanize(spent).alias("duration"),
        c("records_impacted"),
        *error,
        c("error_type"),
        c("host"),
    ]


def log_entry(chars: int | None = None, *, cut: bool = False, named: bool = False) -> list[Column]:
    """Columns of a log line.

    Where no run id is blank (``named``) the id is the column as it is, so Spark knows that rows dealt by it still are.
    """
    c = F.col
    return [
        c("id"),
        iso8601_utc(c("event_time_utc")).alias("event_time_utc"),
        level_name(c("log_level")).alias("level"),
        c("category"),
        c("event_id"),
        c("event_name"),
        *_text("message", chars, cut),
        c("message_template"),
        json_column(c("properties")).alias("properties"),
        c("exception_type"),
        *_text("exception", chars, cut),
        c("activity_id") if named else canonical_id(c("activity_id")).alias("activity_id"),
        c("trace_id"),
        c("span_id"),
        c("application"),
        c("host"),
    ]


def by_time(time: str, *, descending: bool) -> list[Column]:
    """Sort by time, ties by id, both in the same direction."""
    columns = [F.col(time), F.col("id")]
    return [c.desc() for c in columns] if descending else [c.asc() for c in columns]


def after_cursor(time: str, token: Column, *, descending: bool) -> Column:
    """Rows past a cursor; a malformed cursor excludes nothing.

    The row id is compared in the type of the table's id, so a log cursor
    whose id is not a number is malformed too.
    """
    at, row_id = cursor_time(token), cursor_id(token)
    if time == "event_time_utc":
        row_id = row_id.try_cast("bigint")
    t, i = F.col(time), F.col("id")
    past = (t < at) | ((t == at) & (i < row_id)) if descending else (t > at) | ((t == at) & (i > row_id))
    return F.when(at.isNull() | row_id.isNull(), F.lit(True)).otherwise(past)


def _months_before(until: datetime, months: int) -> datetime:
    """The start of the month so many months back; the month that ``until`` ends in is the first."""
    last = until - timedelta(microseconds=1)
    number = max(12, last.year * 12 + last.month - months)
    return datetime(number // 12, number % 12 + 1, 1)


def enough_newest(df: DataFrame, table: str, since: datetime, until: datetime, rows: int, cursor: str | None = None) -> DataFrame:
    """Of filtered rows in a window those of its newest months that hold ``rows`` rows, or all if they do not.

    For pages, newest first, of a table laid out by month: older months are not
    read. One month is tried, then two, four and so on; each try is a small job
    that stops in every task at so many rows, and all tries together read no
    more than twice what the page needs. Other tables are left as they are.
    """
    if MONTH_COLUMN[table] not in df.columns:
        return df
    if cursor and cursor.strip():
        at = df.sparkSession.range(1).select(cursor_time(F.lit(cursor)).alias("at")).first()["at"]
        until = until if at is None else min(until, at + timedelta(microseconds=1))
    months = 1
    while (first := _months_before(until, months)) > since:
        newest = in_window(df, table, first, until)
        if newest.limit(rows).count() >= rows:
            return newest
        months *= 2
    return df


def page(df: DataFrame, time: str, columns: Sequence[Column], limit: int, *, descending: bool) -> DataFrame:
    """The first ``limit`` rows in order, plus ``position`` and ``next_cursor``.

    One row more than asked for is fetched to learn whether a page follows;
    the windows below see no more than those ``limit + 1`` rows. The cursor is
    on the last row only, and only if there is more.
    """
    order = by_time(time, descending=descending)
    fetched = df.orderBy(*order).limit(limit + 1)
    whole = Window.orderBy(*order)
    position = F.row_number().over(whole)
    more = F.lead(F.lit(True)).over(whole)
    return (
        fetched.withColumn("position", position)
        .withColumn("_more", more)
        .where(F.col("position") <= limit)
        .select(
            "position",
            *columns,
            F.when((F.col("position") == limit) & F.col("_more"), cursor_encode(F.col(time), F.col("id"))).alias(
                "next_cursor"
            ),
        )
    )


def paged_result(rows: DataFrame, note: str | None = None) -> DataFrame:
    """One row holding a page: ``items``, ``next_cursor``, ``note``.

    Takes the output of an operator that pages, so the array is no longer than
    the page limit.
    """
    items = [c for c in rows.columns if c not in ("position", "next_cursor")]
    sorted_items = F.array_sort(F.collect_list(F.struct("position", F.struct(*items).alias("item"))))
    return rows.agg(
        F.transform(sorted_items, lambda x: x["item"]).alias("items"),
        F.max("next_cursor").alias("next_cursor"),
        F.lit(note).cast("string").alias("note"),
    )


def to_json(df: DataFrame) -> DataFrame:
    """Every row as one compact JSON text without null fields."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
