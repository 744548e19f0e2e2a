"""What the operators of this package ask of a session, and how they cut lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.plans import checkpoint_dir, prepare

_SETTINGS = {
    # Texts may be long: a batch of rows that goes to a Python worker is bounded in both ways.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark, dealt=False)
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the folder in ``spark.checkpoint.dir`` and read them from there.

    For results that several later steps read. The files are shared, so a lost
    executor loses nothing. They stay until :func:`dismiss`.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4()}"
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[settled] = path
    return settled


def dismiss(*settled: DataFrame) -> None:
    """Give back the disk of settled tables that no later step reads: an empty table takes their place."""
    for df in settled:
        empty(df).write.mode("overwrite").parquet(_folders.pop(df))


def empty(df: DataFrame) -> DataFrame:
    """No rows of the same columns, made without a Python worker: one for RDDs is a process more on each executor's cores."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.sparkSession.range(0).select(*nothing)


def release(context: SparkContext) -> None:
    """Let Spark remove the shuffle files behind settled tables.

    It does so when the driver collects its garbage, which an idle driver may
    not do for half an hour, while executors keep the files.
    """
    gc.collect()
    context._jvm.System.gc()


def portions(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows; what Arrow holds for later is given back behind the last.

    For functions whose working memory is many times that of the texts they
    look at. Python workers outlive their tasks and share an executor's memory
    with the tasks of later stages, so what one task needs at once stays taken.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return to the system what Arrow and the C library hold of memory that is free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)
