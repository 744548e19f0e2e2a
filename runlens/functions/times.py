"""Time formatting, durations, and the windows derived from times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

# Retention horizon of the log table in days, and the note that
# goes with a window older than it.
LOG_RETENTION_DAYS = 90
STALE_NOTE = (
    "window predates the ~90-day log retention horizon; "
    "logs may have been dropped even if the activity resolves"
)


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def at(value: datetime) -> Column:
    """A literal UTC time without zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def iso8601_utc(value: Column) -> Column:
    """Six fraction digits always, ``Z`` suffix; null stays null."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, ties to even. May be negative; null if either end is."""
    return F.rint(micros_between(start, end) / F.lit(1000)).cast("bigint")


def humanize(ms: Column) -> Column:
    """``450ms`` below a second, else ``1d 2h 3m 4s`` without the zero units."""
    seconds = F.call_function("div", ms, F.lit(1000))

    def unit(size: int, modulo: int | None, suffix: str) -> Column:
        n = F.call_function("div", seconds, F.lit(size))
        if modulo is not None:
            n = n % F.lit(modulo)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(suffix)))

    long_form = F.concat_ws(
        " ",
        unit(86400, None, "d"),
        unit(3600, 24, "h"),
        unit(60, 60, "m"),
        F.concat((seconds % F.lit(60)).cast("string"), F.lit("s")),
    )
    return (
        F.when(ms < 0, F.lit(None).cast("string"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms.isNotNull(), long_form)
    )


def bracket(center: Column, n: int) -> tuple[Column, Column]:
    """Half-open ``[center - n days, center + n days)``."""
    return center - days(n), center + days(n)


def near(time: Column, center: Column, n: int, otherwise: Column | None = None) -> Column:
    """Whether ``time`` lies in the bracket of ``n`` days around ``center``.

    An unknown center excludes nothing unless ``otherwise`` says what does. The
    bracket is one cell of a grid as wide as itself, so the center, which may
    be costly, is computed once instead of once per bound.
    """
    reach = n * 86400 * 1000000
    cell = F.floor((micros_between(center, time) + reach) / F.lit(2 * reach))
    return F.coalesce(cell == 0, F.lit(True) if otherwise is None else otherwise)


def log_window(
    *,
    id_time: Column,
    created: Column,
    started: Column,
    completed: Column,
    now: datetime,
    retention_days: int = LOG_RETENTION_DAYS,
) -> tuple[Column, Column]:
    """Where a run's log lines are looked for.

    Lower end: the first known of start, creation and id time, less a day.
    Upper end: the first known of completion, creation and id time, plus a
    day. Each fills in for the other; if nothing is known all that is kept is
    searched, ``retention_days`` back from ``now``.
    """
    lower = F.coalesce(started, created, id_time)
    upper = F.coalesce(completed, created, id_time)
    lo = F.coalesce(F.coalesce(lower, upper) - days(1), at(now) - days(retention_days))
    hi = F.coalesce(F.coalesce(upper, lower) + days(1), at(now) + days(1))
    return lo, hi


def retention_note(window_end: Column, now: datetime, retention_days: int = LOG_RETENTION_DAYS) -> Column:
    """The stale-window note when ``window_end`` lies before the horizon."""
    horizon = at(now) - days(retention_days)
    return F.when(window_end < horizon, F.lit(STALE_NOTE))
