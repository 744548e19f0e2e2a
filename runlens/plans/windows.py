"""Time predicates that let a scan skip months and row groups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from runlens.functions.times import at, bracket
from runlens.functions.ids import uuid7_time
from runlens.plans.session import settled
from runlens.schema import MONTH_COLUMN, TIME_COLUMN

#: The column of an id set that says when its runs were created.
HINT = "created_on"


def month_of(time: Column) -> Column:
    return F.year(time) * F.lit(100) + F.month(time)


def with_month(df: DataFrame, table: str) -> DataFrame:
    """Add the month a partitioned copy of the table is split on."""
    return df.withColumn(MONTH_COLUMN[table], month_of(F.col(TIME_COLUMN[table])))


def _month_number(value: datetime) -> int:
    return value.year * 100 + value.month


def in_window(df: DataFrame, table: str, since: datetime, until: datetime) -> DataFrame:
    """Rows with ``since <= time < until``.

    A filter on the time alone reaches the row groups but not the partition
    directories, so the months are named as well where the table has them.
    """
    time, month = F.col(TIME_COLUMN[table]), MONTH_COLUMN[table]
    inside = (time >= at(since)) & (time < at(until))
    if month in df.columns:
        inside = inside & F.col(month).between(_month_number(since), _month_number(until))
    return df.where(inside)


def id_bounds(
    ids: DataFrame, id_column: str = "activity_id", hint: str | None = None, days: int = 2
) -> DataFrame:
    """Add ``lo`` and ``hi`` around each row's hint or id time; null if neither is known."""
    center = uuid7_time(F.col(id_column))
    if hint is not None and hint in ids.columns:
        center = F.coalesce(F.col(hint), center)
    lo, hi = bracket(center, days)
    return ids.withColumn("lo", lo).withColumn("hi", hi)


def asked_ids(ids: DataFrame, days: int) -> DataFrame:
    """One row per asked-for run: ``activity_id``, its hint, ``lo`` and ``hi``; settled, as plans name it often.

    Of several hints for one run the earliest counts, everywhere.
    """
    hint = F.col(HINT) if HINT in ids.columns else F.lit(None).cast("timestamp_ntz")
    once = ids.groupBy("activity_id").agg(F.min(hint).alias(HINT))
    return settled(id_bounds(once, "activity_id", HINT, days))


#: Months from the first year to the year 9999.
_ALL_MONTHS = 9999 * 12


def touched_months(bounds: DataFrame) -> DataFrame:
    """``month``, one row each, that the ``lo``/``hi`` bounds touch; every month there is if a bound is unknown."""
    first, last = F.trunc("lo", "month"), F.trunc(F.col("hi") - F.expr("INTERVAL 1 MICROSECOND"), "month")
    spans = bounds.where(F.col("lo") < F.col("hi")).select(first.alias("first"), last.alias("last")).distinct()
    each = spans.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("at"))
    unknown = bounds.where(F.col("lo").isNull() | F.col("hi").isNull()).agg(F.count(F.lit(1))).scalar()
    known = each.select(month_of(F.col("at")).alias("month"))
    number = F.col("id").cast("int")
    calendar = bounds.sparkSession.range(_ALL_MONTHS).where(unknown > 0)
    every = calendar.select((F.floor(number / 12).cast("int") * 100 + 100 + number % 12 + 1).alias("month"))
    return known.unionByName(every).distinct()


def within_bounds(df: DataFrame, table: str, bounds: DataFrame) -> DataFrame:
    """Keep the time span that a set of ``lo``/``hi`` bounds covers, and of it the months they touch.

    ``bounds`` should be settled, as the plan names it several times. The span
    is one row, evaluated as a scalar subquery before the scan starts, so row
    groups are skipped and a database gets the times in its statement. In a
    table laid out by month only months that some bound touches are read, by
    dynamic partition pruning: ids from years apart open their own months, not
    all between them. A single unknown bound opens its side.
    """
    month = MONTH_COLUMN[table]

    def edge(aggregate: Column, column: str) -> Column:
        known = F.count(F.lit(1)) == F.count(column)
        return bounds.agg(F.when(known, aggregate).alias("edge")).scalar()

    lo, hi = edge(F.min("lo"), "lo"), edge(F.max("hi"), "hi")
    time = F.col(TIME_COLUMN[table])
    first = F.coalesce(lo, F.lit("0001-01-01").cast("timestamp_ntz"))
    last = F.coalesce(hi, F.lit("9999-12-31").cast("timestamp_ntz"))
    inside = (time >= first) & (time < last)
    if month not in df.columns:
        return df.where(inside)
    # There are no more months than the calendar has. The comparison tells Spark that the list is selective.
    listed = touched_months(bounds).where(F.col("month") > 0).withColumnRenamed("month", month)
    return df.where(inside).join(F.broadcast(listed), month, "left_semi")
