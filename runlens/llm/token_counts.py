"""Token counts by the whole-token shortcut, for a piece vocabulary with byte fallback.

A text becomes words that start with their spaces. No piece holds a space
behind another character, so no merge crosses the start of a word; likewise
none crosses a line end, as no piece holds one. When a model is loaded, every
piece that could be such a word, or a line's continuation, is encoded alone
once: those proved to be one token are counted without looking further. Only
the other words are merged, each once as long as a worker remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Words a worker remembers besides the proved ones before it starts anew; bounds memory, not results.
REMEMBERED = 600_000

_MARK = "▁"
_WORD = re.compile(r" +[^ ]*")


class WordCounts(dict):
    """Tokens of a word, given without the first of its spaces; counts what it does not know."""

    def __init__(self, model: str):
        super().__init__()
        self._encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
        pieces = sentencepiece.SentencePieceProcessor(model_file=model).id_to_piece(list(range(size)))
        inner = [p for p in pieces if _MARK in p.lstrip(_MARK)]
        if inner or any("\n" in p for p in pieces) or self._encode(" \n a") != self._encode(" ") + self._encode("\n")[1:] + self._encode("a"):
            raise ValueError("the model has pieces across words or lines, so words cannot be counted alone")
        starts = [p[1:] for p in pieces if p[:1] == _MARK and _MARK not in p[1:]]
        self._lines = {p: 1 for p in pieces if p and _MARK not in p and len(self._encode(f"\n{p}")) == 3}
        self.proved = {word: 1 for word in starts if word == "" or len(self._encode(word)) == 1}
        self.update(self.proved)

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED + len(self.proved):
            self.clear()
            self.update(self.proved)
        if "\n" in word:
            first, *lines = word.split("\n")
            count = self[first] + sum(1 + self._line(line) for line in lines)
        else:
            count = len(self._encode(word))
        self[word] = count
        return count

    def _line(self, text: str) -> int:
        """Tokens of text right behind a line end; the space mark and the line end count as two."""
        return self._lines.get(text) or (len(self._encode(f"\n{text}")) - 2 if text else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _MARK in text:
            text = text.replace(_MARK, " ")
        words = text.split(" ")
        if "" in words:
            # Runs of spaces belong to the word behind them.
            words = [w[1:] for w in _WORD.findall(f" {text}")]
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_counts(model: str) -> WordCounts:
    """One per worker process and file."""
    return WordCounts(model)


def token_counts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of every whole text.

    ``model`` is the path of a sentencepiece model, the same on every executor.
    The counts are those of its ``encode`` without begin and end. Null and
    empty texts have 0 of both; rows that repeat and null keys stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = word_counts(model).count
        for batch in batches:
            counts = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=[key, "n_bytes", "n_tokens"])

    size: Column = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = df.select(F.col(key), size.alias("n_bytes"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)
