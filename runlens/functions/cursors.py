"""Opaque page cursors: base64 of ``{ticks}|{id}``.

Ticks count 100 ns from year 1. As everything here is a column expression, a
cursor given as a literal is folded to constants by the optimizer and the
keyset predicate reaches the scan like any other comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runlens.functions.times import epoch, micros_between

# Ticks at 1970-01-01 and at the last representable time.
EPOCH_TICKS = 621355968000000000
LAST_TICKS = 3155378975999999999
SEPARATOR = "|"


def cursor_encode(time: Column, row_id: Column) -> Column:
    ticks = micros_between(epoch(), time) * F.lit(10) + F.lit(EPOCH_TICKS)
    payload = F.concat_ws(SEPARATOR, ticks.cast("string"), row_id.cast("string"))
    # base64() breaks lines after 76 characters.
    return F.translate(F.base64(payload.cast("binary")), "\r\n", "")


def _parts(token: Column) -> tuple[Column, Column]:
    payload = F.try_to_binary(F.translate(token, " \t\r\n", ""), F.lit("base64")).cast("string")
    at = F.instr(payload, SEPARATOR)
    ticks = F.substring(payload, F.lit(1), at - 1).try_cast("bigint")
    row_id = F.substring(payload, at + 1, F.length(payload))
    usable = (at > 1) & (at < F.length(payload)) & ticks.between(0, LAST_TICKS)
    return F.when(usable, ticks), F.when(usable, row_id)


def cursor_time(token: Column) -> Column:
    """Time in a cursor; null when the cursor is malformed."""
    ticks, _ = _parts(token)
    micros = F.call_function("div", ticks - F.lit(EPOCH_TICKS), F.lit(10))
    return F.timestamp_add("MICROSECOND", micros, epoch())


def cursor_id(token: Column) -> Column:
    """Row id in a cursor; null when the cursor is malformed."""
    _, row_id = _parts(token)
    return row_id
