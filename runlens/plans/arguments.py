"""Rules that turn caller arguments into fixed values.

Results depend on ``now`` wherever a window is left open. Pass ``since`` and
``until`` (or ``now``) when a result has to be repeatable, for instance while
paging.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from runlens.functions.times import LOG_RETENTION_DAYS

# Default window lengths in days, activity retention in days and
# the note that goes with a capped history window.
CATALOG_DAYS = 30
OVERVIEW_DAYS = 7
LIST_DAYS = 7
LOG_SEARCH_DAYS = 1
HISTORY_DAYS = 90
ACTIVITY_RETENTION_DAYS = 365
HISTORY_CAP_NOTE = "window capped to the ~12-month activity retention horizon"

Time = datetime | str | None


@dataclass(frozen=True)
class Limits:
    """Most rows a page may have, characters a text keeps and levels a lineage goes; days that tables reach back.

    Where one of them cuts a result, a column of the result says so.
    """

    max_activities: int = 200
    max_log_rows: int = 500
    text_chars: int = 500
    lineage_depth: int = 3
    activity_retention_days: int = ACTIVITY_RETENTION_DAYS
    log_retention_days: int = LOG_RETENTION_DAYS

    def chars(self, full: bool) -> int | None:
        return None if full else self.text_chars


DEFAULT_LIMITS = Limits()


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def is_blank(value: str | None) -> bool:
    return value is None or not value.strip()


def parse_utc(value: Time, argument: str) -> datetime | None:
    """UTC if the text has no offset, converted to UTC if it has one."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError:
            raise ValueError(f"{argument}: cannot read '{value}' as an ISO time") from None
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def resolve_window(
    since: Time, until: Time, default_days: int, now: datetime | None = None
) -> tuple[datetime, datetime]:
    """Half-open window; ``since == until`` is legal and empty."""
    end = parse_utc(until, "until") or now or utc_now()
    start = parse_utc(since, "since") or end - timedelta(days=default_days)
    if start > end:
        raise ValueError("since: the window ends before it starts")
    return start, end


def cap_history(since: datetime, until: datetime, days: int = ACTIVITY_RETENTION_DAYS) -> tuple[datetime, str | None]:
    """The window's start, no more than ``days`` before its end, and the note if that moved it."""
    earliest = until - timedelta(days=days)
    return (earliest, HISTORY_CAP_NOTE) if since < earliest else (since, None)


def clamp_limit(requested: int | None, default: int, cap: int) -> int:
    return min(max(default if requested is None else requested, 1), cap)
