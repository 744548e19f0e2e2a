"""Fill-in-the-middle texts by rotating blocks of bytes in place.

A text is cut at two token borders into prefix, middle and suffix. The borders
of a whole batch are found in one scan over its bytes. Each text then becomes a
bytearray: a sentinel goes in front of each part, and two neighbouring blocks
change places by three reversals, of each block and of both together. Undoing
the rotation and taking the sentinels out gives back the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# The sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_ADDED = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


@dataclass(frozen=True)
class Chances:
    """Of 100 texts so many are rearranged, and of 100 of those so many with the suffix first."""

    rearranged: int = 90
    suffix_first: int = 20


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = True
    return table


_IS_LETTER = _letters()


def token_starts(data: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8: does a token start here? A token is a run of A-Z and a-z, or one other code point."""
    letter = _IS_LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def draws(key: object, seed: int = 1) -> list[int]:
    """Four numbers below 2**32 that follow from the seed and the key; a null key counts as the empty text."""
    digest = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Let the blocks ``start:cut`` and ``cut:end`` change places, by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        view[a:b] = view[a:b][::-1].copy()


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two places, in the order of ``form``, a sentinel in front of each part."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return buffer


def restored(output: bytes, form: str) -> bytes:
    """The text that :func:`rearrange` was given."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    if form == PSM:
        start = buffer.index(SUFFIX)
        cut = buffer.index(MIDDLE, start)
    else:
        # The suffix block in front goes back behind prefix and middle.
        start, cut = 0, buffer.index(PREFIX)
    end = len(buffer)
    rotate(buffer, start, cut, end)
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _form(text: bytes, third: int, fourth: int, chances: Chances) -> str:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or third % 100 >= chances.rearranged:
        return PLAIN
    return SPM if fourth % 100 < chances.suffix_first else PSM


def _of_batch(keys: list, texts: list[bytes], seed: int, chances: Chances) -> list[list]:
    """Columns ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` for a batch."""
    columns: list[list] = [[] for _ in _ADDED]
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    # The line feeds between texts keep letters of neighbours apart.
    starts, whole = token_starts(joined), (joined & 0xC0) != 0x80
    begin = 0
    for key, text in zip(keys, texts):
        end = begin + len(text)
        at = np.flatnonzero(starts[begin:end])
        n = len(at)
        first, second, third, fourth = draws(key, seed)
        first, second = sorted((first % (n + 1), second % (n + 1)))
        form = _form(text, third, fourth, chances)
        if form == PLAIN:
            row = (n, form, None, None, text)
        else:
            a, b = (int(at[k]) if k < n else len(text) for k in (first, second))
            chars = [int(np.count_nonzero(whole[begin + x : begin + y])) for x, y in ((0, a), (a, b))]
            row = (n, form, *chars, bytes(rearrange(text, a, b, form)))
        for column, value in zip(columns, row):
            column.append(value)
        begin = end + 1
    return columns


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, chances: Chances = Chances()) -> DataFrame:
    """``key`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, a row for each row.

    ``n`` counts the tokens of the whole text (runs of ASCII letters, and every
    other code point). The cuts and the form follow from the seed and the key
    alone, so a row comes out alike wherever and however often it is computed,
    and rows that repeat come out alike. ``psm`` is prefix, suffix, middle;
    ``spm`` suffix, prefix, middle; ``plain`` the text as it is, with null
    counts: texts that are empty or null (output empty), that hold a sentinel,
    or whose draw says so. Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(key), F.col(text).cast("binary"))
    schema = T.StructType([rows.schema.fields[0], *(T.StructField(name, kind) for name, kind in _ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            *counts, output = _of_batch(keys, texts, seed, chances)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(counts, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(output, pa.binary()).cast(pa.string(), safe=False)], names=schema.names)

    return rows.mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """The rows of ``df`` with ``text`` added: the texts that :func:`transform` was given, null ones as empty.

    A null output gives the empty text, a null form is plain. A ``text`` column
    that is there already is refused.
    """
    if text.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column '{text}' already")
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at_output, at_form = df.columns.index(output), df.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_output).cast(pa.binary()).to_pylist()
            forms = batch.column(at_form).to_pylist()
            back = [restored(t or b"", f or PLAIN) for t, f in zip(texts, forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary()).cast(pa.string(), safe=False)], names=schema.names)

    return df.mapInArrow(run, schema)
