"""Run identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runlens.functions.times import epoch

_HEX = "0123456789abcdef"
#: The twelve time digits of 9999-12-31T23:59:59.999, the last time an id may carry.
_LAST = f"{253402300799999:012x}"


def _above(limit: str) -> str:
    """Pattern of digits that exceed ``limit``: equal up to one place, greater there."""
    patterns = []
    for place, digit in enumerate(limit):
        if digit != _HEX[-1]:
            same = limit[:place] if place <= 8 else f"{limit[:8]}-?{limit[8:place]}"
            hyphen = "-?" if place == 8 else ""
            patterns.append(f"{same}{hyphen}[{_HEX[_HEX.index(digit) + 1 :]}]")
    return "|".join(patterns)


_IN_RANGE = f"(?!{_above(_LAST)})"
_HYPHENATED = _IN_RANGE + "[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}"
_PLAIN = _IN_RANGE + "[0-9a-f]{12}7[0-9a-f]{19}"
_USUAL = rf"(?i)^{_HYPHENATED}$"
_OTHER = rf"(?i)^\s*(?:{_HYPHENATED}|{_PLAIN}|\{{{_HYPHENATED}\}}|\({_HYPHENATED}\))\s*$"


def canonical_id(value: Column) -> Column:
    """Empty ids count as missing."""
    return F.nullif(value, F.lit(""))


#: In front of an id that is no plain UUID, so that its packed form is never 16 bytes long.
_UNPACKED = bytearray(17)


def packed_id(value: Column) -> Column:
    """An id as bytes: 16 for a UUID in lower case with hyphens, its own bytes behind a mark for any other text.

    Different ids stay different, and :func:`unpacked_id` gives every id back as it was.
    """
    plain = value.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
    bare = F.unhex(F.replace(value, F.lit("-"), F.lit("")))
    return F.when(plain, bare).otherwise(F.concat(F.lit(_UNPACKED), value.cast("binary")))


def unpacked_id(value: Column) -> Column:
    """The id that :func:`packed_id` made bytes of."""
    digits = F.lower(F.hex(value))
    parts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    other = F.substring(value, len(_UNPACKED) + 1, 2**31 - 1).cast("string")
    return F.when(F.octet_length(value) == 16, F.concat_ws("-", *parts)).otherwise(other)


def packed_time(value: Column) -> Column:
    """:func:`uuid7_time` of the id that :func:`packed_id` made bytes of."""
    digits = F.hex(F.substring(value, 1, 7))
    ms = F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint")
    known = (F.substring(digits, 13, 1) == "7") & (ms <= int(_LAST, 16))
    plain = F.when(known, F.timestamp_add("MILLISECOND", ms, epoch()))
    return F.when(F.octet_length(value) == 16, plain).otherwise(uuid7_time(unpacked_id(value)))


def uuid7_time(value: Column) -> Column:
    """Creation time inside a version-7 UUID; null for anything else.

    The first 48 bits are Unix milliseconds and the 13th hex digit is the
    version. Plain, hyphenated, braced and parenthesised spellings are read.
    This runs on every log line, so the usual spelling is tried first and the
    range is part of the match.
    """
    bare = F.replace(F.btrim(value, F.lit("{}() \t\r\n")), F.lit("-"), F.lit(""))
    digits = F.when(
        value.rlike(_USUAL), F.concat(F.substring(value, 1, 8), F.substring(value, 10, 4))
    ).when(value.rlike(_OTHER), F.substring(bare, 1, 12))
    return F.timestamp_add("MILLISECOND", F.conv(digits, 16, 10).cast("bigint"), epoch())
