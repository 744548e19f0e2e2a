"""Lines per level, application and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.functions import iso8601_utc, level_counts
from runlens.functions.measures import LEVEL_FIELDS


def level_counts_by_window(logs: DataFrame, *, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The level counts of a log summary, per application and tumbling window.

    Works on a table and on a stream of log lines alike. On a stream a window
    is final, and its state dropped, once lines ``lateness`` newer than its end
    have been seen; lines later than that are ignored. Counts are combined
    before the shuffle, so a busy application does not weigh on one task.
    """
    lines = logs.select("application", "log_level", F.col("event_time_utc").cast("timestamp").alias("time"))
    if logs.isStreaming:
        lines = lines.withWatermark("time", lateness)
    counted = lines.groupBy("application", F.window("time", window).alias("span")).agg(
        F.count(F.lit(1)).alias("total"), *level_counts(F.col("log_level"))
    )
    return counted.select(
        "application",
        iso8601_utc(F.col("span.start")).alias("from_utc"),
        iso8601_utc(F.col("span.end")).alias("until_utc"),
        "total",
        *LEVEL_FIELDS,
    )
