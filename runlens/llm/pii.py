"""Personal data replaced by pseudonyms of the same format.

Every kind of value has a set of valid values of its format, and a keyed
permutation of that set takes each to another one: cards stay cards with a
right check digit, dates stay dates. Values written differently but equal get
the same pseudonym wherever they stand, so documents stay linked; without the
key the way back is not known. What does not hold up to its kind's validation
is left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

ROUNDS = 10


class Permutation:
    """A keyed permutation of the numbers below a size: alternating Feistel rounds.

    The numbers are laid out in a grid of almost equal sides; a round adds a
    keyed hash of one coordinate to the other. What leaves the set, as the grid
    is a little larger, is permuted again until it is back inside.
    """

    def __init__(self, key: bytes):
        self._key = hashlib.sha256(key).digest()

    def _hash(self, tweak: bytes, turn: int, value: int) -> int:
        data = b"%b|%d|%d" % (tweak, turn, value)
        return int.from_bytes(hashlib.blake2b(data, key=self._key, digest_size=48).digest(), "big")

    def _rounds(self, tweak: bytes, order: range, sign: int, a: int, b: int, x: int) -> int:
        left, right = divmod(x, b)
        for turn in order:
            if turn % 2 == 0:
                left = (left + sign * self._hash(tweak, turn, right)) % a
            else:
                right = (right + sign * self._hash(tweak, turn, left)) % b
        return left * b + right

    def _walk(self, kind: str, size: int, value: int, order: range, sign: int) -> int:
        b = math.isqrt(size - 1) + 1 if size > 1 else 1
        a = -(-size // b)
        tweak = f"{kind}/{size}".encode()
        while True:
            value = self._rounds(tweak, order, sign, a, b, value)
            if value < size:
                return value

    def apply(self, kind: str, size: int, value: int) -> int:
        return self._walk(kind, size, value, range(ROUNDS), 1)

    def invert(self, kind: str, size: int, value: int) -> int:
        return self._walk(kind, size, value, range(ROUNDS - 1, -1, -1), -1)


def luhn_digit(digits: str) -> str:
    """The check digit that goes behind these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return str(-total % 10)


def _refilled(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isascii() and c.isdigit() else c for c in pattern)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


Move = Callable[[str, int, int], int]


def _card(found: str, move: Move) -> str | None:
    digits = _only_digits(found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    width = len(digits) - 1
    body = str(move("card", 10**width, int(digits[:-1]))).zfill(width)
    return _refilled(found, body + luhn_digit(body))


def _phone(found: str, move: Move) -> str | None:
    head = re.match(r"\+\d{1,3}(?=[ .(-])|", found).group()
    digits = _only_digits(found[len(head) :])
    if not 7 <= len(digits) <= 12:
        return None
    return head + _refilled(found[len(head) :], str(move("phone", 10 ** len(digits), int(digits))).zfill(len(digits)))


def _social(found: str, move: Move) -> str | None:
    area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    # Areas 1 to 899 without 666; groups 1 to 99; serials 1 to 9999.
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(move("social", 898 * 99 * 9999, value), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}{found[3]}{group + 1:02d}{found[6]}{serial + 1:04d}"


def _ip(found: str, move: Move) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = move("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, value.to_bytes(4, "big")))


def _in_classes(kind: str, text: str, move: Move) -> str:
    """Letters and digits of a text permuted as one number, each staying what it is, case included."""
    radix = [26 if c.isalpha() else 10 for c in text if c.isascii() and c.isalnum()]
    value = 0
    for c, r in zip((c for c in text if c.isascii() and c.isalnum()), radix):
        value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
    value = move(f"{kind}/{''.join('a' if r == 26 else '9' for r in radix)}", math.prod(radix), value)
    places = []
    for r in reversed(radix):
        value, place = divmod(value, r)
        places.append(place)
    out = []
    for c in text:
        if not (c.isascii() and c.isalnum()):
            out.append(c)
        elif c.isdigit():
            out.append(str(places.pop()))
        else:
            letter = chr(97 + places.pop())
            out.append(letter.upper() if c.isupper() else letter)
    return "".join(out)


def _email(found: str, move: Move) -> str | None:
    """All but the top-level domain is permuted; addresses are equal whatever their case."""
    local, _, domain = found.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_in_classes('email', f'{local}@{host}', move)}.{top}"


def _iban_check(country: str, rest: str) -> int:
    """Of the country and the account: the check digits that fit."""
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return 98 - int(number) % 97


def _iban(found: str, move: Move) -> str | None:
    plain = found.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(rest) <= 30 or _iban_check(country, rest) != int(check):
        return None
    moved = _in_classes(f"iban/{country}", rest, move)
    source = iter(f"{country}{_iban_check(country, moved):02d}{moved}")
    return "".join(c if c == " " else next(source) for c in found)


_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: The days up to the 12th of each month, which would read as a month in front of a slash, and the others.
_EARLY, _LATE = ([d for d in range(_FIRST_DAY.toordinal(), _LAST_DAY.toordinal() + 1) if (date.fromordinal(d).day > 12) == late] for late in (False, True))


def _date(found: str, move: Move) -> str | None:
    """Days from 1900 to 2099. Behind a slash-separated number up to 12 stands the day, else the month.

    Days up to 12 are permuted among themselves and so are the others, so a
    pseudonym reads in the order of its format and is the same in all formats.
    """
    parts = re.split(r"\D", found)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif "/" in found and int(parts[0]) <= 12:
        order = (2, 0, 1)
    else:
        order = (2, 1, 0)
    year, month, day = (int(parts[i]) for i in order)
    try:
        at = date(year, month, day)
    except ValueError:
        return None
    if not _FIRST_DAY <= at <= _LAST_DAY:
        return None
    days = _LATE if day > 12 else _EARLY
    moved = date.fromordinal(days[move("date", len(days), bisect_left(days, at.toordinal()))])
    new = [""] * 3
    for i, v in zip(order, (moved.year, moved.month, moved.day)):
        # Where a number is written without a zero in front, all are.
        new[i] = str(v) if min(map(len, parts)) == 1 else f"{v:02d}"
    separators = re.findall(r"\D", found)
    return f"{new[0]}{separators[0]}{new[1]}{separators[1]}{new[2]}"


# Earlier kinds win where several could start at one place. All lengths are bounded (those of
# addresses as mail allows them), so no text of any length takes more than its length's time.
KINDS: dict[str, tuple[str, Callable[[str, Move], str | None]]] = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,12}[A-Za-z]{2,63}(?![\w-])", _email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "card": (r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    "social": (r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])", _social),
    "date": (r"(?<![\w./-])(?:\d{4}(?P<a>[./-])\d{1,2}(?P=a)\d{1,2}|\d{1,2}(?P<b>[./-])\d{1,2}(?P=b)\d{4})(?![\w/-]|\.\d)", _date),
    "phone": (
        r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
        _phone,
    ),
}
_KINDS = {name: re.compile(pattern) for name, (pattern, _) in KINDS.items()}
_ANY = re.compile("|".join(f"(?:{pattern})" for pattern, _ in KINDS.values()))
_HINT = re.compile(r"[0-9@]")
#: Kinds of no fixed length: what follows a value may look like more of it.
_OPEN = ("iban", "card", "phone")
_CARD_GROUPS = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}(?:\1\d{4})?(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}")
_CARD_LOOSE = re.compile(r"\d{4,}(?:[ -]\d{4,})*")
# The lengths of the registered countries' IBANs.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _usual(kind: str, found: str) -> bool:
    """Whether a value is of a usual length and layout of its kind, so what follows is not part of it."""
    if kind == "card":
        return _CARD_GROUPS.fullmatch(found) is not None
    if kind == "iban":
        return _IBAN_LENGTHS.get(found[:2], 0) in (0, len(found.replace(" ", "")))
    # Of the countries' numbers only those behind +1 have one length.
    return kind != "phone" or re.match(r"\+1[ .(-]", found) is None or len(_only_digits(found)) == 11


class Pseudonyms:
    def __init__(self, key: bytes):
        self._move = Permutation(key).apply

    def replace(self, text: str | None) -> tuple[str | None, int]:
        """The text with its personal data replaced, and how many values that were."""
        if not text or _HINT.search(text) is None:
            return text, 0
        out, at, count, look = [], 0, 0, 0
        while (found := _ANY.search(text, look)) is not None:
            start = found.start()
            usual, end, new = self._at(text, start) or (True, 0, "")
            if not end or (not usual and self._usual_inside(text, start + 1, end)):
                # No value starts here; a later start may be one.
                look = start + 1
                continue
            out += [text[at:start], new]
            at = look = end
            count += 1
        return "".join([*out, text[at:]]), count

    def _usual_inside(self, text: str, look: int, end: int) -> bool:
        """Whether a value of a usual form starts before the end of one that is not."""
        while (found := _ANY.search(text, look)) is not None and (look := found.start() + 1) <= end:
            if (value := self._at(text, found.start())) is not None and value[0]:
                return True
        return False

    def _at(self, text: str, start: int) -> tuple[bool, int, str] | None:
        """The value that starts at a place: whether its form is usual, its end and its pseudonym.

        Usual forms come first, then earlier kinds. Of the ends a card could
        have in a usual layout the first is its end; otherwise longer values
        come first.
        """
        best = None
        for name, pattern in _KINDS.items():
            found = pattern.match(text, start)
            if found is None:
                continue
            last = found.end()
            ends = [last, *(i for i in range(last - 1, start, -1) if name in _OPEN and text[i] in " .-")]
            places = [(not _usual(name, text[start:end]), end) for end in ends if pattern.fullmatch(text, start, end)]
            if name == "card":
                # Shorter ends of an unusual layout only where no group is small, as lists of numbers would pass by chance.
                loose = [place for place in places if place[0] and _CARD_LOOSE.fullmatch(text, start, place[1])]
                places = [*((odd, end) for odd, end in reversed(places) if not odd), *loose, (True, last)]
            else:
                places.sort(key=lambda place: place[0])
            for odd, end in places:
                if odd and best is not None:
                    break
                if (new := KINDS[name][1](text[start:end], self._move)) is not None:
                    best = not odd, end, new
                    break
            if best is not None and best[0]:
                return best
        return best


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", count: str = "n_pii") -> DataFrame:
    """The rows with personal data in ``text`` replaced, and ``count`` of the values added.

    ``key`` decides the pseudonyms; keep it from who gets the texts. Null stays
    null and empty stays empty, both with count 0. Rows that repeat stay equal.
    A column named like ``count`` is replaced.
    """
    rows = df.drop(count)
    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Pseudonyms(key).replace
        for batch in batches:
            done = [replace(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
