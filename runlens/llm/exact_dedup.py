"""Exact duplicates by progressive refinement: length, then a hash of the start, then of all.

The first pass reads texts for their length and the hash of their first
characters and groups those small keys. Groups of two rows or more are marked
in a bit field of fixed size, which every executor gets. The second pass takes
the full hash of rows whose bit is set and of no others; a bit set by chance
costs one hash and changes nothing. Texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.llm.session import settle
from runlens.plans import spread

#: Characters whose hash stands for the start of a text.
PREFIX_CHARS = 256
#: Bits in the field of surviving groups. Every executor gets bits / 64 rows of two
#: longs (at this value 131,072 rows, about 2 MB), whatever the size of the data.
FIELD_BITS = 1 << 23


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("_n", "_p"), F.lit(bits))


def _keyed(df: DataFrame, content: Column) -> DataFrame:
    """The rows with ``_norm``, ``_n`` (its length) and ``_p`` (the hash of its start)."""
    return (
        df.withColumn("_norm", content)
        .withColumn("_n", F.length("_norm"))
        .withColumn("_p", F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)))
    )


def candidates(df: DataFrame, content: Column, bits: int = FIELD_BITS) -> DataFrame:
    """The rows with their ``content`` in ``_norm``, and ``_again``: may it occur twice, going by length and start?"""
    keys = settle(_keyed(df, content).groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_c")))
    lengths = keys.groupBy("_n").agg(F.sum("_c").alias("_rows")).where(F.col("_rows") > 1).select("_n")
    groups = keys.join(lengths, "_n", "left_semi").where(F.col("_c") > 1)
    field = (
        groups.withColumn("_bit", _bit(bits))
        .groupBy(F.floor(F.col("_bit") / 64).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 AS int))")).alias("_bits"))
    )
    bit = _bit(bits)
    marked = _keyed(df, content).withColumn("_word", F.floor(bit / 64)).withColumn("_at", (bit % 64).cast("int"))
    joined = marked.join(F.broadcast(field), "_word", "left")
    again = F.coalesce(F.expr("shiftrightunsigned(_bits, _at)").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn("_again", again).drop("_word", "_at", "_bits")


def duplicate_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False, field_bits: int = FIELD_BITS
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Equal means equal after :func:`normalised`, so null equals empty. ``keep_id``
    is the smallest key of the group. ``text_sha256`` is the digest of the
    normalised text; null for rows that needed none, unless ``digests`` asks
    for all. Of rows that repeat both key and text one is kept. Null keys are
    larger than all others: a group of nothing else has ``keep_id`` null and
    keeps one row. Other columns do not matter and are left out. Rows of a
    group meet only as counts, and the join back splits hot groups.
    """
    rows = candidates(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), normalised(F.col("_text")), field_bits)
    full = F.sha2("_norm", 256)
    digest = full if digests else F.when(F.col("_again"), full)
    # Rows that have no partner need a group of their own that no digest can equal.
    alone = F.concat_ws("/", F.lit("alone"), "_key", "_n", "_p")
    grouped = settle(
        rows.select("_key", digest.alias("_sha"), F.when(F.col("_again"), full).otherwise(alone).alias("_group"))
        .groupBy("_group", "_key", "_sha")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    sizes = grouped.groupBy("_group").agg(F.min("_key").alias("keep_id"), F.sum("_m").alias("group_size"))
    joined = grouped.join(spread(sizes, "_group"), "_group")
    each = joined.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return each.select(
        F.col("_key").alias(key),
        "keep_id",
        F.col("group_size").cast("long"),
        (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", field_bits: int = FIELD_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows that have no partner go by as they are read. Only the others are
    joined with what is to go. Of rows that repeat key and text, the first in
    the order of their other columns stays.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key_name, text_name = names[df.columns.index(key)], names[df.columns.index(text)]
    rows = candidates(plain, normalised(F.col(text_name)), field_bits)
    once = rows.where(~F.col("_again")).select(*names)
    again = rows.where("_again").withColumn("_sha", F.sha2("_norm", 256))
    narrow = settle(again.select(F.col(key_name).alias("_key"), "_sha").groupBy("_sha", "_key").agg(F.count(F.lit(1)).alias("_m")))
    keep = narrow.groupBy("_sha").agg(F.min("_key").alias("_keep"))
    gone = narrow.join(spread(keep, "_sha"), "_sha").where(~F.col("_key").eqNullSafe(F.col("_keep")))
    gone = gone.select(F.col("_key").alias("_gone"), F.col("_sha").alias("_gone_sha"))
    stay = again.join(gone, F.col(key_name).eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    ordered = [F.col(n).cast("string") for n in names if n not in (key_name, text_name)] + [F.col(text_name)]
    first = F.row_number().over(Window.partitionBy(key_name, "_sha").orderBy(*ordered))
    stay = stay.withColumn("_first", first).where(F.col("_first") == 1)
    return once.unionByName(stay.select(*names)).toDF(*df.columns)
