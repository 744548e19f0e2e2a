"""Rates, counts and percentiles. Rounding is half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEVEL_FIELDS = ("trace", "debug", "information", "warning", "error", "critical")


def half_even(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def success_rate(succeeded: Column, failed: Column, canceled: Column) -> Column:
    """Share of completed runs that succeeded, four decimals, null if none completed."""
    completed = succeeded + failed + canceled
    ratio = succeeded / F.nullif(completed, F.lit(0).cast("bigint"))
    return F.rint(ratio * F.lit(10000.0)) / F.lit(10000.0)


def level_counts(level: Column, count: Column | None = None) -> list[Column]:
    """Six aggregates, one per level 0..5; a level that is absent gives null."""
    one = F.lit(1).cast("bigint") if count is None else count
    return [F.sum(F.when(level == i, one)).alias(name) for i, name in enumerate(LEVEL_FIELDS)]


def percentile_of_sorted(values: Column, p: float) -> Column:
    """Linear interpolation at rank ``p * (n - 1)`` of a sorted array."""
    rank = F.lit(float(p)) * (F.size(values) - 1)
    below = F.floor(rank).cast("int")
    low, high = F.get(values, below), F.get(values, F.ceil(rank).cast("int"))
    return half_even(low + (high - low) * (rank - below))
