"""Shards that all have the mixture of the whole, by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked. A rank
becomes a fraction: how far into its source a row stands. Sorting all rows by
their fractions interleaves the sources in proportion, so any stretch of that
order holds each source's share of it, and cutting it into stretches of equal
length gives shards whose sizes differ by one row at most.

Each source's fractions are set off by a phase of its own. Without it all
sources of a single row would stand in the middle, in the same shard.

No source is one group. Both orders are range partitioned, so a source that
has a third of all rows lies in a third of the partitions; a row's number is
its place in its partition and the count of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.llm.session import settle
from runlens.plans import spread

#: Rows stand in their partition's order: the lower bits of the running number count within a partition.
_PLACE_BITS = 33


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Settled rows in global order, with the partition ``_part`` they lie in and their place ``_at`` in it.

    Rows that agree in all of ``order`` may change places with each other.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_number", number)
    return settle(numbered).select(
        *df.columns,
        F.shiftright("_number", _PLACE_BITS).alias("_part"),
        F.col("_number").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_at"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows by ``_stratum`` and shuffle order with their rank ``_rank`` and the rows ``_size`` of the stratum.

    A partition has one or a few spans of each stratum in it, and there is one row for each
    span; a stratum has no more spans than there are partitions.
    """
    spans = rows.groupBy("_part", "_stratum").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    of_stratum = Window.partitionBy("_stratum").orderBy("_part")
    before = F.sum("_n").over(of_stratum.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    size = F.sum("_n").over(Window.partitionBy("_stratum"))
    placed = spans.withColumn("_before", before).withColumn("_size", size).drop("_n")
    joined = rows.join(spread(placed, "_stratum"), ["_part", "_stratum"])
    return joined.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_from")).drop("_before", "_from", "_at", "_part")


def fraction(rank: Column, size: Column, stratum: Column, seed: int) -> Column:
    """How far into its stratum a row of this rank (from 0) stands: from 0 up to 1."""
    phase = F.pmod(F.xxhash64(F.lit(seed), stratum), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return (rank + phase) / size


def interleave(df: DataFrame, shards: int, source: str = "source", order: Sequence[str] = ("doc_id",), seed: int = 1) -> DataFrame:
    """The rows of ``df`` with ``shard`` (from 0) and ``slot`` (from 0 without gaps in each shard).

    Row counts of shards differ by one at most. Sources keep their proportions
    in each shard but for a row or two; a source of few rows, by chance of its
    phase, is in some shards and not in others. A null source is a source of its own. ``order`` names the columns whose seeded hash shuffles a
    source; rows alike in them go by the other columns, and rows alike in all
    are interchangeable. Which shard a row gets depends on the data and the
    seed, not on partitions. Fewer rows than shards leave shards empty; no rows,
    no result rows. All columns stay; ``shard`` and ``slot`` must be new, and
    none may start with an underscore.

    Two shuffles move the columns of ``df`` by sorted ranges, so long texts are
    better joined back or written with :func:`write_shards` afterwards. What
    reaches the driver is a count for each partition.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    clash = [c for c in df.columns if c.startswith("_") or c.lower() in ("shard", "slot")]
    if clash:
        raise ValueError(f"columns {clash} would clash")
    by_name = [F.col(c) for c in (*order, *(c for c in df.columns if c not in order))]
    stratum = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.withColumn("_stratum", stratum).withColumn("_hash", F.xxhash64(F.lit(seed), *(F.col(c) for c in order)))
    ranked = _ranked(_numbered(rows, [F.col("_stratum"), F.col("_hash"), *by_name]))
    fractions = ranked.withColumn("_fraction", fraction(F.col("_rank"), F.col("_size"), F.col("_stratum"), seed))
    mixed = _numbered(fractions.drop("_size", "_hash"), [F.col("_fraction"), F.col("_stratum"), F.col("_rank")])

    counts = {r["_part"]: r["_n"] for r in mixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()}
    total, parts = sum(counts.values()), sorted(counts)
    before = dict(zip(parts, accumulate((counts[p] for p in parts), initial=0)))
    starts = df.sparkSession.createDataFrame([*before.items()] or [(0, 0)], "_part long, _before long")
    placed = mixed.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_before") + F.col("_at"))
    # Shard s takes the places from ceil(s total / shards) on.
    cut = placed.withColumn("_shard", F.expr(f"_place * {shards} div {max(total, 1)}"))
    slot = F.expr(f"_place - (_shard * {total} + {shards - 1}) div {shards}")
    return cut.select(*df.columns, F.col("_shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the shards as Parquet folders ``shard=0`` and so on, each in files that go on from slot to slot."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def mixture(sharded: DataFrame, source: str = "source") -> DataFrame:
    """``shard``, ``source`` and ``rows``: what each shard is made of."""
    return sharded.groupBy("shard", source).agg(F.count(F.lit(1)).alias("rows"))
