"""Scalar rules as column expressions built only from Spark functions."""

from runlens.functions.cursors import cursor_encode, cursor_id, cursor_time
from runlens.functions.ids import canonical_id, packed_id, packed_time, unpacked_id, uuid7_time
from runlens.functions.levels import level_name, level_value
from runlens.functions.measures import half_even, level_counts, percentile_of_sorted, success_rate
from runlens.functions.statements import check_statement, statement_error
from runlens.functions.text import contains_ci, json_column, like_escape, truncate, was_truncated
from runlens.functions.times import (
    bracket,
    days,
    duration_ms,
    humanize,
    iso8601_utc,
    log_window,
    micros_between,
    near,
    retention_note,
)

__all__ = [
    "bracket",
    "canonical_id",
    "check_statement",
    "contains_ci",
    "cursor_encode",
    "cursor_id",
    "cursor_time",
    "days",
    "duration_ms",
    "half_even",
    "humanize",
    "iso8601_utc",
    "json_column",
    "level_counts",
    "level_name",
    "level_value",
    "like_escape",
    "log_window",
    "micros_between",
    "near",
    "packed_id",
    "packed_time",
    "percentile_of_sorted",
    "retention_note",
    "statement_error",
    "success_rate",
    "truncate",
    "unpacked_id",
    "uuid7_time",
    "was_truncated",
]
