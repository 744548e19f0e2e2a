"""Readers that give the three tables their declared columns."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.functions import iso8601_utc
from runlens.functions.times import at, micros_between
from runlens.plans.windows import with_month
from runlens.schema import MONTH_COLUMN, TIME_COLUMN, conform


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table kept as Parquet, partitioned by month or not."""
    return conform(spark.read.parquet(path), table)


def read_table(spark: SparkSession, name: str, table: str) -> DataFrame:
    """A table known to the catalog of the session."""
    return conform(spark.table(name), table)


def jdbc_options(
    url: str,
    table: str,
    *,
    since: datetime,
    until: datetime,
    partitions: int,
    properties: Mapping[str, str] | None = None,
    dbtable: str | None = None,
) -> dict[str, str]:
    """Options of a parallel database read that is split on the time column.

    Spark pushes column lists and filters of the operators into each of the
    ``partitions`` statements. Rows outside the two times are still read, by
    the first and last statement.
    """
    return {
        **(properties or {}),
        "url": url,
        "dbtable": dbtable or table,
        "partitionColumn": TIME_COLUMN[table],
        "lowerBound": since.isoformat(sep=" "),
        "upperBound": until.isoformat(sep=" "),
        "numPartitions": str(partitions),
        "preferTimestampNTZ": "true",
        "pushDownPredicate": "true",
    }


def read_jdbc(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    """A table in a MySQL or MariaDB database; needs its driver on the class path."""
    return conform(spark.read.format("jdbc").options(**jdbc_options(url, table, **how)).load(), table)


_EPOCH = datetime(1970, 1, 1)


def _micros_column(table: str) -> str:
    return f"{TIME_COLUMN[table]}_micros"


def write_by_month(df: DataFrame, path: str, table: str, *, partitions: int | None = None) -> None:
    """Lay a table out so that windows skip months and, within them, row groups.

    Rows are range-partitioned on (month, application, time): a month or an
    application with a third of all rows still spreads over tasks and files.
    The time is also kept as a number of microseconds, for :func:`month_coverage`.
    """
    order = [MONTH_COLUMN[table], TIME_COLUMN[table]]
    if "application" in df.columns:
        order.insert(1, "application")
    micros = micros_between(at(_EPOCH), F.col(TIME_COLUMN[table]))
    # In front, as Spark looks a column up in a footer by its place among those asked for.
    dated = with_month(df.select(micros.alias(_micros_column(table)), "*"), table)
    ranged = dated.repartitionByRange(partitions, *order) if partitions else dated.repartitionByRange(*order)
    ranged.sortWithinPartitions(*[F.col(c) for c in order]).write.partitionBy(MONTH_COLUMN[table]).parquet(path)


def month_coverage(
    spark: SparkSession, path: str, table: str, *, first_month: int | None = None, last_month: int | None = None
) -> DataFrame:
    """Per month of a table written by :func:`write_by_month`: its rows, first and last time.

    ``month`` is a number such as 202401; the bounds are inclusive. The answers
    stand in the footers of the files: Spark's second Parquet source takes them
    from there, so no row is read however large the table is. It does so for
    numbers but not for times, hence the column of microseconds. An empty
    table has no months; a time is never null.
    """
    month, micros = MONTH_COLUMN[table], _micros_column(table)
    listed = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(listed)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # The source is chosen when the reader loads, so the setting need not stay.
    spark.conf.set(listed, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        rows = spark.read.schema(f"{micros} BIGINT, {month} INT").parquet(path)
    finally:
        spark.conf.set(listed, before)
    if first_month is not None:
        rows = rows.where(F.col(month) >= first_month)
    if last_month is not None:
        rows = rows.where(F.col(month) <= last_month)
    months = rows.groupBy(month).agg(F.count(F.lit(1)).alias("rows"), F.min(micros).alias("first"), F.max(micros).alias("last"))

    def time(name: str) -> Column:
        return iso8601_utc(F.timestamp_add("MICROSECOND", F.col(name), at(_EPOCH)))

    return months.select(
        F.col(month).alias("month"), "rows", time("first").alias("first_utc"), time("last").alias("last_utc")
    )
