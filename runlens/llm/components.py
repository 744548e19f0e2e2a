"""Connected components of a table of links, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runlens.llm.session import settle

#: Two links that bound what a node may have before its links are dealt out further.
_SIDES = ("a", "b")


def _hung(links: DataFrame, larger: bool) -> DataFrame:
    """One half round: each node's neighbours on one side hang on its smallest neighbour.

    The minimum of a node goes back to its links by a join on a narrow table,
    whose hot nodes adaptive execution can split.
    """
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if larger else both.where(F.col("b") < F.col("a"))
    least = seen.groupBy("a").agg(F.min("b").alias("_m"))
    least = least.select((F.col("a") + F.lit(0)).alias("_a"), F.least("a", "_m").alias("_m"))
    side = both.where(F.col("b") > F.col("a")) if larger else seen
    moved = side.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    if not larger:
        moved = moved.unionAll(least.select(F.col("_a").alias("a"), F.col("_m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``links`` (``a``, ``b``).

    Rounds alternate between larger and smaller neighbours until every link
    points at the smallest node of its component; the number of rounds grows
    with the logarithm of the longest path. Each round is settled, so lineage
    stays short and a lost executor costs one round. Links may repeat, in
    either direction; a link of a node with itself makes it known. Links with
    a null are left out. No links, no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    alone = links.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = settle(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now = settle(_hung(_hung(now, larger=True), larger=False))
        after = state(now)
        if after == before:
            break
        before = after
    known = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).unionAll(alone).distinct().join(known.select("node"), "node", "left_anti")
    return known.unionByName(roots.withColumn("component", F.col("node")))
