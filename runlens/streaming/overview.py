"""Fleet health kept up to date by a stream of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.operators.rollup import _with_type, added_figures, figures, shown_figures
from runlens.plans import is_blank
from runlens.plans.arguments import Time, parse_utc

KEYS = ["day", "application", "activity_type"]
_FIGURES = (
    "day date, application string, activity_type string, runs long, succeeded long, failed long, canceled long, running long, "
    "skipped long, micros decimal(38,0), timed long, total_records_impacted decimal(38,0), last_run timestamp_ntz, last_failure timestamp_ntz"
)
_ORDER = [field.split()[0] for field in _FIGURES.split(", ")]


class FleetState:
    """The figures of an overview per day, application and type, folded in batch by batch.

    Give :meth:`fold` to ``writeStream.foreachBatch``. What a batch adds is
    written under its number, in place of what an earlier try of the same batch
    may have left: a batch that is sent again, whole or after a failure half
    way, counts once. :meth:`compact` adds up what has come so far and notes
    through which batch; batches up to that one are known and ignored. So the
    numbers are the ledger. They must come from one stream and its checkpoint,
    and one writer at a time.

    A row is a run in its final state: a run that comes twice in different
    batches counts twice. State is a row for each day, application and type,
    and as much again for each batch since the last compaction.
    """

    def __init__(self, spark: SparkSession, path: str):
        """``path`` is a folder all executors share; it is made where there is none."""
        self._spark, self._parts, self._base = spark, f"{path}/parts", f"{path}/base"
        for folder, number in ((self._parts, "batch"), (self._base, "through")):
            spark.createDataFrame([], f"{_FIGURES}, {number} long").write.mode("append").partitionBy(number).parquet(folder)

    def _read(self, folder: str, number: str) -> DataFrame:
        return self._spark.read.schema(f"{_FIGURES}, {number} long").parquet(folder)

    def _through(self) -> int:
        """The last batch that was added up, or -1."""
        last = self._read(self._base, "through").agg(F.max("through")).first()[0]
        return -1 if last is None else last

    def _write(self, rows: DataFrame, folder: str, number: str, value: int) -> None:
        numbered = rows.select(*_ORDER, F.lit(value).cast("long").alias(number))
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(number).parquet(folder)

    def fold(self, runs: DataFrame, batch: int) -> None:
        """Take in a batch of runs. Rows are combined before the shuffle; an empty batch adds nothing."""
        if batch > self._through():
            dated = runs.withColumn("day", F.to_date("created_on"))
            self._write(dated.groupBy(*KEYS).agg(*figures()), self._parts, "batch", batch)

    def _figures(self) -> DataFrame:
        through = self._through()
        base = self._read(self._base, "through").where(F.col("through") == through).drop("through")
        parts = self._read(self._parts, "batch").where(F.col("batch") > through).drop("batch")
        return base.unionByName(parts)

    def compact(self) -> None:
        """Add up all batches so far; their files, and earlier sums, are not read again and may be removed."""
        last = self._read(self._parts, "batch").agg(F.max("batch")).first()[0]
        if last is not None and last > self._through():
            self._write(self._figures().groupBy(*KEYS).agg(*added_figures()), self._base, "through", last)

    def overview(self, *, since: Time = None, until: Time = None, application: str | None = None, group_by: str | None = None) -> DataFrame:
        """As :func:`~runlens.operators.fleet_overview`, over whole days: from that of ``since`` to before that of ``until``."""
        rows = self._figures()
        first, last = parse_utc(since, "since"), parse_utc(until, "until")
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first.date()))
        if last is not None:
            rows = rows.where(F.col("day") < F.lit(last.date()))
        if not is_blank(application):
            rows = rows.where(F.col("application") == application)
        keys = KEYS[1:] if (group_by or "").lower() == "application_type" else KEYS[1:2]
        return _with_type(shown_figures(rows.groupBy(*keys).agg(*added_figures()), keys))
