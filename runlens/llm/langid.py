"""Languages of texts and of stretches inside them.

The script of a word narrows its candidates to the languages that use the
script. Every word gets a score for each candidate from its character n-grams,
and the best sequence of labels over the words of a text (Viterbi), with a
penalty for every switch, cuts the text into spans of one language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from runlens.llm.session import portions

#: Documents of each language the model is fitted on, in expectation; languages with fewer give all.
SAMPLE_PER_LANGUAGE = 2_000
#: More languages than this are refused: the model that reaches every task has 256 KB for each.
MOST_LANGUAGES = 256
#: What a change of language costs, in the units of the scores (natural logarithms).
SWITCH = 18.0
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

LONGEST_NGRAM = 4
BUCKETS = 1 << 15
#: Words a worker remembers the scores of before it starts anew.
REMEMBERED = 200_000
#: So many texts are looked at at once: scores and paths of their words take some 100 times their size.
TEXTS = 100

# First and last code points of Unicode's blocks, by script.
SCRIPTS = {
    "Latin": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x024F), (0x1E00, 0x1EFF)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F),),
    "Armenian": ((0x0530, 0x058F),),
    "Hebrew": ((0x0590, 0x05FF),),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),),
    "Gurmukhi": ((0x0A00, 0x0A7F),),
    "Gujarati": ((0x0A80, 0x0AFF),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Lao": ((0x0E80, 0x0EFF),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "Kana": ((0x3040, 0x30FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_STARTS, _SCRIPT_AT = (
    np.array(x)
    for x in zip(*sorted((p, s) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges for p, s in ((a, i + 1), (b + 1, 0))))
)
_N_SCRIPTS = len(SCRIPTS) + 1

_WORDS = re.compile(r"([^\W\d_]+)")


def _letters(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each with a space on both sides, and the lengths with them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def _ngrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words in lower case, and the word of each."""
    lowered = [w.lower() for w in words]
    codes, lengths = _codes(lowered)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_NGRAM + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :].astype(np.uint64)
        inside = owner[: len(rolled)] == owner[n - 1 :]
        if n == 1:
            inside &= codes != 32
        mixed = (rolled[inside] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        buckets.append((mixed >> np.uint64(49)).astype(np.int64))
        owners.append(owner[: len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _script_counts(words: Sequence[str]) -> np.ndarray:
    codes, _ = _codes(words)
    return np.bincount(_scripts(codes), minlength=_N_SCRIPTS)


def _scripts(codes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    return np.where(at >= 0, _SCRIPT_AT[at], 0)


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each row of ``scores``; rows in ``starts`` begin a sequence of their own.

    All sequences are one, with free switches where one starts. It is cut into
    about as many blocks as a block has rows. All blocks advance together, from
    every state they could be entered in; a short walk over the blocks finds
    the states they are entered in, and a second pass labels their rows.
    """
    rows, states = scores.shape
    if rows == 0 or states == 1:
        return np.zeros(rows, np.int64)
    size = max(1, int(np.sqrt(rows)))
    blocks = -(-rows // size)
    cost = np.full(blocks * size, switch)
    cost[np.flatnonzero(starts)] = 0.0
    cost[rows:] = 0.0
    padded = np.zeros((blocks * size, states))
    padded[:rows] = scores
    cost, padded = cost.reshape(blocks, size), padded.reshape(blocks, size, states)

    def step(best: np.ndarray, k: int) -> np.ndarray:
        moved = best.max(-1, keepdims=True) - (cost[:, k, None, None] if best.ndim == 3 else cost[:, k, None])
        add = padded[:, k, None, :] if best.ndim == 3 else padded[:, k]
        return np.maximum(best, moved) + add

    through = np.broadcast_to(np.where(np.eye(states, dtype=bool), 0.0, -np.inf), (blocks, states, states))
    for k in range(size):
        through = step(through, k)
    value, came = np.zeros(states), np.zeros((blocks, states), np.int64)
    for b in range(blocks):
        options = value[:, None] + through[b]
        came[b] = options.argmax(0)
        value = options.max(0) - options.max()
    leave = np.zeros(blocks, np.int64)
    state = int(value.argmax())
    for b in range(blocks - 1, -1, -1):
        leave[b] = state
        state = came[b, state]
    enter = np.append(state, leave[:-1])

    best = np.where(np.arange(states) == enter[:, None], 0.0, -np.inf)
    source, stays = np.zeros((size, blocks), np.int64), np.zeros((size, blocks, states), bool)
    for k in range(size):
        source[k] = best.argmax(-1)
        stays[k] = best >= best.max(-1, keepdims=True) - cost[:, k, None]
        best = step(best, k)
    labels, now, every = np.zeros((blocks, size), np.int64), leave, np.arange(blocks)
    for k in range(size - 1, -1, -1):
        labels[:, k] = now
        now = np.where(stays[k, every, now], now, source[k])
    return labels.reshape(-1)[:rows]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # by bucket and language: logarithm of the share, against the languages' mean
    allowed: np.ndarray  # by script and language
    _known: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.languages, self.weights, self.allowed

    def __setstate__(self, state):
        self.languages, self.weights, self.allowed = state
        self._known, self._scores = {}, None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Each word's score for each language; languages that do not use its script are out of reach."""
        buckets, owner = _ngrams(words)
        out = np.stack([np.bincount(owner, self.weights[buckets, j], len(words)) for j in range(len(self.languages))], axis=1)
        codes, lengths = _codes(words)
        first = _scripts(codes[np.cumsum(lengths) - lengths + 1])
        allowed = self.allowed[first]
        out = np.where(allowed, out, out.min(1, keepdims=True) - 10 * SWITCH)
        return np.where(allowed.any(1, keepdims=True), out, 0.0)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known = self._known
        before = len(known)
        ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
        if len(known) > before:
            fresh = self.word_scores(list(known)[before:])
            self._scores = fresh if before == 0 else np.concatenate([self._scores[:before], fresh])
        return ids

    def label(self, texts: Sequence[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Language, its share of the letters, and spans (``start``, ``end``, ``lang``) of each text."""
        split = [_WORDS.split(t or "") for t in texts]
        words = [w for parts in split for w in parts[1::2]]
        counts = [len(parts) // 2 for parts in split]
        scores = self._scores_of(words)
        begins = np.zeros(len(words), bool)
        ends = np.cumsum(counts)
        begins[(ends - counts)[np.array(counts, np.int64) > 0]] = True
        labels = viterbi(scores, begins, SWITCH)
        letters = np.fromiter(map(_letters, words), np.int64, len(words))
        out = []
        for parts, count, end in zip(split, counts, ends):
            mine, weight = labels[end - count : end], letters[end - count : end]
            total = int(weight.sum())
            if total == 0:
                out.append((UNKNOWN, 0.0, []))
                continue
            by_language = np.bincount(mine, weight, len(self.languages))
            best = int(by_language.argmax())
            places = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            cuts = np.flatnonzero(mine[1:] != mine[:-1])
            firsts, lasts = np.append(0, cuts + 1), np.append(cuts, count - 1)
            spans = [
                {"start": int(places[2 * a]), "end": int(places[2 * b + 1]), "lang": self.languages[mine[a]]} for a, b in zip(firsts, lasts)
            ]
            out.append((self.languages[best], float(by_language[best] / total), spans))
        return out

    def _scores_of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        ids = self._ids(words)
        return self._scores[ids]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from labelled rows; null texts and labels are left out, none left give no model.

    All rows are counted; of each language about ``sample`` rows, told by a
    hash of the key, are read for their n-grams. Spark sums the counts; the
    driver gets one table of fixed size for each language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    grain = 1_000_000
    share = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(grain, -(-sample * grain // n)))))
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(grain)) < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in portions(batches, TEXTS):
            by_language: dict[str, list[str]] = {}
            for words, name in zip(map(_WORDS.findall, batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                by_language.setdefault(name, []).extend(words)
            for name, words in by_language.items():
                table = tables.setdefault(name, np.zeros(BUCKETS + _N_SCRIPTS, np.int64))
                if words:
                    table[:BUCKETS] += np.bincount(_ngrams(words)[0], minlength=BUCKETS)
                    table[BUCKETS:] += _script_counts(words)
        yield from _tables(tables)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = np.frombuffer(zlib.decompress(packed), np.int64)
                tables[name] = tables[name] + table if name in tables else table
        yield from _tables(tables)

    schema = "lang string, counts binary"
    summed = chosen.mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect()
    tables = {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in summed}
    languages = sorted(tables)
    if not languages:
        return None
    ngrams = np.stack([tables[x][:BUCKETS] for x in languages], axis=1).astype(float) + 0.5
    logs = np.log(ngrams / ngrams.sum(0))
    scripts = np.stack([tables[x][BUCKETS:] for x in languages], axis=1).astype(float)
    scripts[0] = 0
    shares = scripts / np.maximum(1, scripts.sum(0))
    return Model(languages, logs - logs.mean(1, keepdims=True), shares >= SCRIPT_SHARE)


def _tables(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if tables:
        packed = pa.array([zlib.compress(t.tobytes(), 1) for t in tables.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.string()), packed], names=["lang", "counts"])


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``spans`` added.

    ``lang_pred`` is the language of most letters, ``und`` for texts that are
    null or have no letters; ``score`` is its share of the letters, 0 for
    ``und``. ``spans`` say which language stands where, in characters. Ties go
    to the name that sorts first. Without a model, as nothing was labelled,
    every text is ``und``. Columns of these names are replaced.
    """
    rows = df.drop("lang_pred", "score", "spans")
    context = df.sparkSession.sparkContext
    shared = context.broadcast(model)
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    schema = T.StructType([*rows.schema.fields, *added.fields])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in portions(batches, TEXTS):
            texts = batch.column(at).to_pylist()
            found = model.label(texts) if model is not None else [(UNKNOWN, 0.0, [])] * len(texts)
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), _ARROW_SPANS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """The quarter of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
