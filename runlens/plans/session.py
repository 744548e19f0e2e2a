"""Session settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Times without zone are turned into instants by some functions.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where an aggregate on that key follows the join:
    # the partial aggregate then runs on every split, before the extra shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods above this size. Result rows are wide,
    # and one such method per row is slower than expressions split over many.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Ranks are cut before the shuffle for every page size a caller may ask for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}

#: What a task scans at once, where the session has no value of its own. Ranks are cut in the task that scans, so it
#: sorts its rows, which are many times as wide as the narrow columns some of them come from: those of a usual split
#: of 128 MB do not fit a task's memory, and all of them are spilled.
_SPLIT = ("spark.sql.files.maxPartitionBytes", "16m")

#: How many partitions a shuffle of runs, edges or lines is dealt into at least, and the size they are put together to where
#: there is little to shuffle, likewise. A task behind such a shuffle sorts rows many times as large as they were shuffled,
#: up to three times over, so partitions of 64 MB hardly fit it either.
_DEALT = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "500",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

#: Whether the shuffles of an execution go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession, *, dealt: bool = True) -> SparkSession:
    """The session with the settings above. ``dealt=False`` leaves out, or takes back, those for shuffles of wide rows."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(_SPLIT[0], None) is None:
        spark.conf.set(*_SPLIT)
    first = next(iter(_DEALT))
    for key, value in _DEALT.items():
        wanted = dealt and (key != first or int(spark.conf.get("spark.sql.shuffle.partitions")) < int(value))
        own = spark.conf.get(key, None)
        if wanted and own is None:
            spark.conf.set(key, value)
        elif not wanted and own == value:
            spark.conf.unset(key)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        known = tempfile.mkdtemp(prefix="runlens-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in ``spark.checkpoint.dir`` and read from there.

    For narrow results that one plan needs in several places, such as the ids
    asked for and the times they span: they are computed once, when this is
    called, and a lost executor loses nothing. The shuffles behind them go
    when they are written, so their files do not lie beside those of later ones.
    """
    conf, path = df.sparkSession.conf, f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4()}"
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
