"""Operators on streams."""

from runlens.streaming.latest import LatestRuns
from runlens.streaming.levels import level_counts_by_window
from runlens.streaming.overview import FleetState

__all__ = ["FleetState", "LatestRuns", "level_counts_by_window"]
