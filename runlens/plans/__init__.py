"""Argument rules and the plan helpers operators share."""

from runlens.plans.arguments import (
    HISTORY_CAP_NOTE,
    Limits,
    cap_history,
    clamp_limit,
    is_blank,
    parse_utc,
    resolve_window,
    utc_now,
)
from runlens.plans.session import checkpoint_dir, prepare, settled
from runlens.plans.shuffles import latest_per_key, spread
from runlens.plans.windows import HINT, asked_ids, id_bounds, in_window, with_month, within_bounds

__all__ = [
    "HINT",
    "HISTORY_CAP_NOTE",
    "Limits",
    "asked_ids",
    "cap_history",
    "checkpoint_dir",
    "clamp_limit",
    "id_bounds",
    "in_window",
    "is_blank",
    "latest_per_key",
    "parse_utc",
    "prepare",
    "resolve_window",
    "settled",
    "spread",
    "utc_now",
    "with_month",
    "within_bounds",
]
