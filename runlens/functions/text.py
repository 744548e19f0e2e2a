"""Text and JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def truncate(value: Column, n: int | None) -> Column:
    """At most ``n`` characters; ``None`` or a number below 1 keeps all."""
    if n is None or n <= 0:
        return value
    return F.substring(value, 1, n)


def was_truncated(value: Column, n: int | None) -> Column:
    """Whether :func:`truncate` cuts; null for null text."""
    if n is None or n <= 0:
        return F.when(value.isNotNull(), F.lit(False))
    return F.length(value) > n


def contains_ci(value: Column, term: str) -> Column:
    """Substring match without case; ``%`` and ``_`` are ordinary characters."""
    return F.contains(F.lower(value), F.lower(F.lit(term)))


def like_escape(value: Column) -> Column:
    """Make text literal inside a LIKE pattern whose escape character is ``!``."""
    for special in ("!", "%", "_"):
        value = F.replace(value, F.lit(special), F.lit("!" + special))
    return value


def json_column(value: Column) -> Column:
    """Parsed JSON; blank text is null and invalid JSON becomes a JSON string."""
    parsed = F.coalesce(F.try_parse_json(value), value.cast("variant"))
    return F.when(value.rlike(r"\S"), parsed)
