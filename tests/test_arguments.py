from __future__ import annotations

from datetime import datetime

import pytest

from runlens.plans import HISTORY_CAP_NOTE, Limits, cap_history, clamp_limit, parse_utc, resolve_window

NOW = datetime(2024, 6, 1, 12)


def test_times_are_utc_unless_they_say_otherwise():
    assert parse_utc("2024-01-01T10:00:00", "since") == datetime(2024, 1, 1, 10)
    assert parse_utc("2024-01-01T10:00:00Z", "since") == datetime(2024, 1, 1, 10)
    assert parse_utc("2024-01-01T10:00:00+02:00", "since") == datetime(2024, 1, 1, 8)
    assert parse_utc("2024-01-01", "since") == datetime(2024, 1, 1)
    assert parse_utc(" ", "since") is None and parse_utc(None, "since") is None
    with pytest.raises(ValueError, match="since: cannot read 'soon'"):
        parse_utc("soon", "since")


def test_window_defaults_and_order():
    assert resolve_window(None, None, 7, NOW) == (datetime(2024, 5, 25, 12), NOW)
    assert resolve_window(None, "2024-01-08", 7, NOW) == (datetime(2024, 1, 1), datetime(2024, 1, 8))
    assert resolve_window("2024-01-08", "2024-01-08", 7)[0] == datetime(2024, 1, 8)
    with pytest.raises(ValueError, match="ends before it starts"):
        resolve_window("2024-01-09", "2024-01-08", 7)


def test_history_cap():
    until = datetime(2024, 12, 31)
    assert cap_history(datetime(2020, 1, 1), until) == (datetime(2024, 1, 1), HISTORY_CAP_NOTE)
    assert cap_history(datetime(2024, 1, 1), until) == (datetime(2024, 1, 1), None)


@pytest.mark.parametrize("asked, got", [(None, 25), (0, 1), (-5, 1), (7, 7), (1000, 200)])
def test_limit(asked, got):
    assert clamp_limit(asked, 25, 200) == got


def test_full_text_means_no_limit():
    assert Limits().chars(False) == 500 and Limits().chars(True) is None
