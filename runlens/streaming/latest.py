"""The newest row of each run, kept up to date by a stream of runs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from runlens.functions.times import at
from runlens.plans import latest_per_key
from runlens.schema import ACTIVITY, conform

OPEN, FINAL, LATE = "open", "final", "late"


class LatestRuns:
    """Of several rows with one id the newest, from a stream that sends runs again as they go on.

    Give :meth:`fold` to ``writeStream.foreachBatch``. Three kinds of rows are
    kept. A row created more than ``lateness_days`` before the newest row of
    all earlier batches is ``late``: it goes to an output of its own, for
    counting or repair, and changes nothing else. The newest row of a run that
    may still change is ``open``. Once it is older than that limit it is
    ``final``, and later batches do not read it again; so the state that
    travels from batch to batch holds no more than the runs of that many days.
    A run that comes back after it was final is open anew.

    All that a batch writes stands under its number and takes the place of what
    an earlier try may have left, and a batch reads only what the batches
    before it wrote. So one that is sent again, whole or after a failure half
    way, changes nothing. The numbers must come from one stream and its
    checkpoint, and one writer at a time. Open rows under numbers before the
    last one are not read again and may be removed, unless one of the batches
    behind them could still be sent again.

    Rows without an id are one run; of equal times either row stays. Columns
    that runs do not have are left out, and those that are missing are null.
    """

    def __init__(self, spark: SparkSession, path: str, *, lateness_days: int = 2):
        """``path`` is a folder all executors share; it is made where there is none."""
        if lateness_days < 0:
            raise ValueError("lateness_days must not be negative")
        self._spark, self._path, self._lateness = spark, path, timedelta(days=lateness_days)
        self._schema = T.StructType([*ACTIVITY.fields, T.StructField("kind", T.StringType()), T.StructField("batch", T.LongType())])
        self._write(spark.createDataFrame([], self._schema), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("kind", "batch").parquet(self._path)

    def _kept(self, kind: str, spark: SparkSession | None = None) -> DataFrame:
        return (spark or self._spark).read.schema(self._schema).parquet(self._path).where(F.col("kind") == kind)

    def _open(self, before: int | None = None, spark: SparkSession | None = None) -> tuple[DataFrame, datetime | None]:
        """The open rows of the last batch, or of the last one before a number, and the newest time in them.

        The newest row of all is always open, so its time is that of the stream.
        """
        rows = self._kept(OPEN, spark)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (-1 if last is None else last)).drop("kind", "batch")
        return rows, None if last is None else rows.agg(F.max("created_on")).first()[0]

    def fold(self, runs: DataFrame, batch: int) -> None:
        """Take in a batch of runs. The open rows go along, also behind a batch without rows.

        One shuffle by id; the rank is cut in every task before it, so a run
        that is sent very often sends a row for each task.
        """
        # A batch of a stream has a session of its own.
        known, newest = self._open(batch, runs.sparkSession)
        arrived = conform(runs, "activity").select(ACTIVITY.fieldNames())
        old = F.lit(False) if newest is None else F.col("created_on") < at(newest - self._lateness)
        # A time that is missing is no older than anything.
        old = F.coalesce(old, F.lit(False))
        both = known.withColumn("_late", F.lit(False)).unionByName(arrived.withColumn("_late", old))
        on_time = latest_per_key(both.where(~F.col("_late")), ["id"], [F.col("created_on").desc()])
        kinds = on_time.withColumn("kind", F.when(old, FINAL).otherwise(OPEN))
        kinds = kinds.unionByName(both.where("_late").withColumn("kind", F.lit(LATE)))
        self._write(kinds.drop("_late").withColumn("batch", F.lit(batch).cast("long")), "overwrite")

    def latest(self) -> DataFrame:
        """The newest row of each run among those that were not late."""
        rows = self._kept(FINAL).drop("kind", "batch").unionByName(self._open()[0])
        return latest_per_key(rows, ["id"], [F.col("created_on").desc()])

    def late(self) -> DataFrame:
        """The rows that came too late, with the ``batch`` that brought them."""
        return self._kept(LATE).drop("kind")
