"""All page boundaries of a result in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from runlens.functions import cursor_encode, iso8601_utc
from runlens.operators.shapes import by_time
from runlens.plans import checkpoint_dir

# monotonically_increasing_id() keeps the row number within a partition in its
# lower 33 bits and the partition number above them.
_ROW_BITS = 33


def page_manifest(
    df: DataFrame, time: str, page_size: int, *, descending: bool = True, partitions: int | None = None
) -> DataFrame:
    """One row per page: its number, size, ends, and the cursor that starts it.

    With the cursors an exporter fetches all pages at once instead of one
    after another. Rows are range-partitioned on (time, id), so many rows of
    one instant still spread over tasks. A row's place is its place in its
    partition plus the sizes of the partitions before; only those sizes, one
    number per partition, meet in a single task.

    The ranged rows (time and id only) are written to the checkpoint folder
    first, because a second range partitioning need not cut at the same rows.
    """
    checkpoint_dir(df.sparkSession)
    order = by_time(time, descending=descending)
    keys = df.select(time, "id")
    ranged = keys.repartitionByRange(partitions, *order) if partitions else keys.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("_place", place)
        .select(
            time,
            "id",
            F.shiftright("_place", _ROW_BITS).alias("part"),
            F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row"),
        )
        .checkpoint()
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    everything = Window.orderBy("part")
    starts = sizes.select(
        "part",
        (F.sum("size").over(everything) - F.col("size")).alias("start"),
        F.sum("size").over(Window.partitionBy()).alias("total"),
    )
    number = F.col("start") + F.col("row")
    # As many rows as there are partitions, so this side is always small.
    numbered = placed.join(F.broadcast(starts), "part").withColumn("number", number)
    last = F.col("number") == F.col("total") - 1
    in_page = F.col("number") % page_size
    ends = numbered.where((in_page == 0) | (in_page == page_size - 1) | last).select(
        F.call_function("div", F.col("number"), F.lit(page_size)).alias("page"), "number", "total", time, "id"
    )

    def end_of(edge, column):
        return edge(F.col(column), F.col("number"))

    pages = ends.groupBy("page").agg(
        (F.max("number") - F.min("number") + 1).alias("row_count"),
        end_of(F.min_by, time).alias("first_time"),
        end_of(F.max_by, time).alias("last_time"),
        end_of(F.max_by, "id").alias("last_id"),
        (F.max("number") < F.max("total") - 1).alias("has_more"),
    )
    return pages.select(
        (F.col("page") + 1).alias("page"),
        "row_count",
        iso8601_utc(F.col("first_time")).alias("first_time_utc"),
        iso8601_utc(F.col("last_time")).alias("last_time_utc"),
        "last_id",
        F.when(F.col("has_more"), cursor_encode(F.col("last_time"), F.col("last_id"))).alias("next_cursor"),
    )
