"""Shuffle shapes shared by the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    The rank limit is applied on both sides of the shuffle, so a key sends one
    row per task however many rows it has.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Ready the narrow side of a join whose other side may have a hot key.

    Adaptive execution splits a skewed partition only if both join inputs come
    straight from a shuffle. A side that was just grouped or ranked by the join
    key is partitioned on it already and gets no shuffle, so a third of all log
    lines or edges could stay in one task. Joining on a computed copy of the
    key asks for that shuffle, of narrow rows; a plain repartition() on the
    same key would be optimized away.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))
