"""Best-fit packing of documents into sequences, planned on counts of lengths.

Lengths are whole numbers up to the capacity, so what has to be planned is a
histogram of at most ``capacity`` counts, however many documents there are.
Items above a third of the capacity come first: at most two fit into a bin, and
each, from the largest down, is matched with the largest that still fits. The
smaller ones, largest first, go to the bin with the tightest gap that takes
them, and into new bins where no gap does. The plan says how many bins hold
which lengths; items then find their places by their number among the items of
their length, which Spark counts in bounded parts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from runlens.llm.session import settle

#: Items of one length are numbered in parts of about this many.
PART_ROWS = 50_000


@dataclass
class _Bins:
    """``count`` bins that hold the same lengths: pairs of a length and how often."""

    count: int
    gap: int
    holds: list[tuple[int, int]] = field(default_factory=list)

    def with_more(self, count: int, size: int, times: int) -> _Bins:
        return _Bins(count, self.gap - size * times, [*self.holds, (size, times)])


def _match_large(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Pairs of items above a third of the capacity: the largest with the largest that fits."""
    bins: list[_Bins] = []
    left = {s: n for s, n in counts.items() if 3 * s > capacity and n}
    sizes = sorted(left)
    while sizes:
        a = sizes[-1]
        at = bisect_right(sizes, capacity - a)
        if at == 0:
            bins.append(_Bins(left[a], capacity - a, [(a, 1)]))
            sizes.pop()
            continue
        b = sizes[at - 1]
        if a == b:
            pairs, odd = divmod(left[a], 2)
            if pairs:
                bins.append(_Bins(pairs, capacity - 2 * a, [(a, 2)]))
                left[a] = odd
            # A last one of its size takes the next smaller.
            if odd and len(sizes) > 1:
                b = sizes[-2]
                bins.append(_Bins(1, capacity - a - b, [(a, 1), (b, 1)]))
                left[b] -= 1
            elif odd:
                bins.append(_Bins(1, capacity - a, [(a, 1)]))
            left[a] = 0
        else:
            pairs = min(left[a], left[b])
            bins.append(_Bins(pairs, capacity - a - b, [(a, 1), (b, 1)]))
            left[a] -= pairs
            left[b] -= pairs
        sizes = [s for s in sizes if left[s]] if not (left[a] and left[b]) else sizes
    return bins


def _fit_small(counts: dict[int, int], capacity: int, bins: list[_Bins]) -> list[_Bins]:
    by_gap: dict[int, list[_Bins]] = {}
    for b in bins:
        by_gap.setdefault(b.gap, []).append(b)
    gaps = sorted(by_gap)

    def put(b: _Bins) -> None:
        if b.gap not in by_gap:
            gaps.insert(bisect_left(gaps, b.gap), b.gap)
        by_gap.setdefault(b.gap, []).append(b)

    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                put(_Bins(-(-left // (capacity // size)), capacity))
                continue
            gap = gaps[at]
            group = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
            # A bin stays the tightest until nothing more of this size fits.
            times = gap // size
            if full := min(group.count, left // times):
                put(group.with_more(full, size, times))
                left -= full * times
            elif left:
                full = 1
                put(group.with_more(1, size, left))
                left = 0
            if group.count > full:
                put(_Bins(group.count - full, gap, group.holds))
    return [b for group in by_gap.values() for b in group if b.holds]


@dataclass(frozen=True)
class Plan:
    """Places by length and number among the items of that length.

    ``start`` holds ``length << 40 | first number`` in order; an item belongs
    to the last entry at or before its own.
    """

    start: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, (length << 40) | number, side="right") - 1
        into = number - (self.start[at] & ((1 << 40) - 1))
        return self.first_bin[at] + into // self.per_bin[at], self.offset[at] + into % self.per_bin[at] * length


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Bins for so many items of each length, all between 1 and the capacity."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    bins = _fit_small(counts, capacity, _match_large(counts, capacity))
    rows, number, first = [], dict.fromkeys(counts, 0), 0
    for b in bins:
        offset = 0
        for size, times in b.holds:
            rows.append((size << 40 | number[size], first, times, offset))
            number[size] += b.count * times
            offset += size * times
        first += b.count
    if number != {s: n for s, n in counts.items()}:
        raise AssertionError("the plan does not place every item once")
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy(), first)


def pieces(encoded: DataFrame, capacity: int, end_id: int = 0, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, ``end_id`` behind each document.

    ``encoded`` has ``ids`` packed as little-endian unsigned 32-bit integers;
    null counts as none. A longer document is cut into whole pieces from its
    end, so only its first piece may be shorter. Returns ``key``, ``piece``,
    ``start``, ``length`` and the piece's ``ids``.
    """
    end = F.lit(bytearray(end_id.to_bytes(4, "little")))
    whole = encoded.select(F.col(key), F.concat(F.coalesce(F.col(ids), F.lit(bytearray())), end).alias("_ids"))
    total = (F.octet_length("_ids") / 4).cast("int")
    sized = whole.withColumn("_total", total).withColumn("_first", (F.col("_total") - 1) % capacity + 1)

    def piece(p):
        start = F.when(p == 0, 0).otherwise(F.col("_first") + (p - 1) * capacity)
        length = F.when(p == 0, F.col("_first")).otherwise(capacity)
        return F.struct(
            p.cast("int").alias("piece"),
            start.cast("long").alias("start"),
            length.cast("long").alias("length"),
            F.substring(F.col("_ids"), start * 4 + 1, length * 4).alias("ids"),
        )

    count = F.floor((F.col("_total") - 1) / capacity)
    return sized.select(key, F.inline(F.transform(F.sequence(F.lit(0).cast("long"), count), piece)))


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """The items with ``sequence_id`` and ``offset``: as few sequences as best fit finds.

    ``items`` has a ``length`` between 1 and ``capacity``, and columns
    ``order`` that tell items of one length apart; items alike in all of them
    are interchangeable. The rows are settled first, as they are read three
    times. What reaches the driver is one count per length. Numbering sorts
    parts of about :data:`PART_ROWS` items, so a length that most items have
    is no large group. No items give no sequences.
    """
    items = settle(items)
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(counts, capacity)
    parts = max(1, -(-max(counts.values(), default=0) // PART_ROWS))
    dealt = items.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order))
    numbered = (
        dealt.withColumn("_inside", inside - 1)
        .join(before, ["length", "_part"])
        .withColumn("_number", F.col("_inside") + F.col("_before"))
        .select(*items.columns, "_number")
    )
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = places.places(length, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, packed, from pieces that carry ``ids``; a sequence is at most the capacity long."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(bytearray()), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
