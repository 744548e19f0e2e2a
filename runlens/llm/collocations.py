"""Phrases whose words go together, counted by sorting pointers to suffixes.

Every word starts a suffix: itself and up to four words behind it, to the end
of its piece of text. All suffixes with the same leading words are sent to one
task, and each task sorts pointers to its suffixes by multikey three-way
quicksort: partition by the word at the current depth into smaller, equal and
larger, and go one word deeper in the equal part. The weight of an equal part
is the count of the phrase that leads to it, and a part lighter than the least
count holds no phrase that matters and is abandoned.

Suffixes that a task meets more than once travel as one row with a count.
Leading words are two; those that start more than a small share of all
suffixes lead by three, or four, or five, so no group is large. What such a
split leaves of a shorter phrase in each task is added up at the end. Which
they are is read off a sketch of fixed size, that counts too high at worst.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm.session import settle
from runlens.plans import spread

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
UNKNOWN = "und"

#: Counters for each length of leading words. Workers and driver hold 8 bytes for each.
SKETCH_COUNTERS = 1 << 18
#: Leading words lead by one more where they start one in so many of all words.
HOT_SHARE = 4096
#: Bits that mark the frequent words; workers hold a bit for each (2 MB).
FIELD_BITS = 1 << 24
#: Suffixes are dealt to cells, and a task holds one cell at a time: so many at least, and more
#: where a cell would get more suffixes than this.
CELLS = 64
CELL_WORDS = 1_000_000
#: Bytes of text a task looks at together.
BLOCK = 4 << 20
#: Bytes of phrases a task hands on together.
OUT_BYTES = 4 << 20

# Fixed value: what ends a piece.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_LINE = ord("\n")
_END = 0  # number of the end of a piece, among the numbers of words
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_ENDS) + b" ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of words in the order they come up; the end of a piece is 0, no word at all 1."""

    def __init__(self):
        super().__init__({b"\n": _END, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _blocks(texts: Sequence[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The texts, lower-cased and with one kind of end and blank, in blocks; does a piece end with the block?

    A block ends with a piece where there is an end in it, else between words, else goes on to where one ends.
    """
    data = b"\n".join(texts).translate(_TABLE)
    at = 0
    while len(data) - at > BLOCK:
        cut = data.rfind(b"\n", at, at + BLOCK)
        if cut < 0:
            cut = data.rfind(b" ", at, at + BLOCK)
        if cut < 0:
            ends = [e for e in (data.find(b"\n", at + BLOCK), data.find(b" ", at + BLOCK)) if e >= 0]
            if not ends:
                break
            cut = min(ends)
        yield data[at:cut], data[cut] == _LINE
        at = cut + 1
    yield data[at:], True


def _words(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, int, _Numbers]]:
    """Numbers of the words of each block with 0 where a piece ends, how many of them start a suffix, and the numbering.

    Where a piece goes on in the next block, its last words are handed over to it.
    """
    numbers, kept = _Numbers(), np.zeros(0, np.int64)
    for block, ended in _blocks(texts):
        words = block.replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        flat = np.concatenate((kept, found[found != 1], np.zeros(MOST_WORDS if ended else 0, np.int64)))
        starts = len(flat) if ended else max(0, len(flat) - MOST_WORDS + 1)
        kept = flat[starts:]
        yield flat, starts, numbers
        if ended and len(numbers) > 500_000:
            numbers = _Numbers()


def _hashes(numbers: _Numbers, lang: str) -> np.ndarray:
    """What Spark's ``xxhash64(lang, word)`` gives for each word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)
    out = np.fromiter((xxhash.xxh64_intdigest(word, seed=seed) for word in numbers), np.uint64, len(numbers))
    out[_END] = 0
    return out


def _leads(flat: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The hash of the first two, three, four and five words of each suffix; what is behind an end counts as ends."""
    rolled = np.zeros(len(starts), np.uint64)
    open_ = np.ones(len(starts), bool)
    for depth in range(MOST_WORDS):
        word = flat[starts + depth]
        open_ &= word != _END
        rolled = (rolled ^ np.where(open_, hashes[word], 0).astype(np.uint64)) * _STEP
        rolled ^= rolled >> np.uint64(29)
        if depth:
            yield depth + 1, rolled


def _slots(lead: np.ndarray, width: int) -> np.ndarray:
    return (lead >> np.uint64(32)).astype(np.int64) % width


def _suffix_starts(flat: np.ndarray, count: int) -> np.ndarray:
    """Places of suffixes of two words or more; the others are no part of a phrase's count."""
    at = np.arange(max(0, min(count, len(flat) - 1)))
    return at[(flat[at] != _END) & (flat[at + 1] != _END)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language, about a block of them together; no more than four blocks wait."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                lang = UNKNOWN if lang is None else lang
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= BLOCK:
                    yield lang, waiting.pop(lang)
                    del sizes[lang]
        if sum(sizes.values()) >= 4 * BLOCK:
            yield from waiting.items()
            waiting, sizes = {}, {}
    yield from waiting.items()


_PROFILE = "lang string, word string, count long, part int, counts binary"


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """One pass: counts of words, and for each length of leading words the counters of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((MOST_WORDS + 1, width), np.int64)
        names = ["lang", "word", "count", "part", "counts"]
        for lang, texts in _gathered(batches):
            seen: dict[bytes, int] = {}
            for flat, count, numbers in _words(texts):
                starts = _suffix_starts(flat, count)
                padded = np.append(flat, np.zeros(MOST_WORDS, np.int64))
                for depth, lead in _leads(padded, starts, _hashes(numbers, lang)):
                    if depth < MOST_WORDS:
                        counters[depth] += np.bincount(_slots(lead, width), minlength=width)
                # Words handed over to the next block are counted there.
                counts = np.bincount(flat[:count], minlength=len(numbers)).tolist()
                for word, number in zip(numbers, counts):
                    if number:
                        seen[word] = seen.get(word, 0) + number
            seen.pop(b"\n", None)
            words = pa.array([*seen], pa.binary()).cast(pa.string(), safe=False)
            rows = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), words, pa.array([*seen.values()], pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=names,
            )
        for depth in range(2, MOST_WORDS):
            if counters[depth].any():
                packed = pa.array([zlib.compress(counters[depth].tobytes(), 1)], pa.binary())
                none = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([depth], pa.int32()), packed], names=names)

    return docs.mapInArrow(run, _PROFILE)


def _hot(profile: DataFrame, width: int, most: int) -> np.ndarray:
    """For each length of leading words and counter: do they start more than ``most`` suffixes?

    The counters of the tasks are added up in a tree of tasks, and their sums, one
    array of fixed size for each length, reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[part] = sums[part] + piece if part in sums else piece
        for part, piece in sums.items():
            packed = pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), packed], names=["part", "counts"])

    parts = profile.where(F.col("part").isNotNull()).select("part", "counts")
    # First each task adds up what it made, then a few tasks for each length, then the driver.
    dealt = parts.mapInArrow(add, "part int, counts binary").withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(16)))
    summed = dealt.repartition(F.col("part"), F.col("_deal")).select("part", "counts").mapInArrow(add, "part int, counts binary")
    counters = np.zeros((MOST_WORDS + 1, width), np.int64)
    for row in summed.toLocalIterator():
        counters[row["part"]] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return counters > most


def _frequent(words: DataFrame, bits: int) -> np.ndarray:
    """A bit field of fixed size, built by Spark in words of 64 bits: may a word with this hash occur often enough?"""
    bit = F.pmod(F.xxhash64("lang", "word"), F.lit(bits))
    cells = words.select(F.floor(bit / 64).cast("long").alias("cell"), (bit % 64).cast("int").alias("at"))
    field = np.zeros(bits // 64, np.int64)
    for row in cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toLocalIterator():
        field[row["cell"]] = row["bits"]
    return field.view(np.uint8)


_SUFFIXES = "cell int, lang string, depth int, phrases binary, size int, counts binary"


def _distinct(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes alike in all their words one place, and how many there are.

    Two, four, then five words become one number each, pairs of numbers by sorting them.
    """

    def numbered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.unique((high << 32) | low, return_inverse=True)[1]

    columns, open_ = [], np.ones(len(starts), bool)
    for depth in range(MOST_WORDS):
        word = flat[starts + depth]
        open_ = open_ & (word != _END)
        columns.append(np.where(open_, word, _END))
    four = numbered(numbered(columns[0], columns[1]), numbered(columns[2], columns[3]))
    _, first, counts = np.unique((four << 32) | columns[4], return_index=True, return_counts=True)
    return starts[first], counts


def _suffixes(docs: DataFrame, shared: Broadcast, cells: int) -> DataFrame:
    """Suffixes of two to five words, alike ones of a block once with their count, packed by the cell they go to.

    ``depth`` of their words lead them. No frequent phrase goes on over a word that is rare by
    itself, so suffixes end there.
    """

    def rows(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        frequent, hot = shared.value
        width, bits = hot.shape[1], 8 * len(frequent)
        for flat, count, numbers in _words(texts):
            hashes = _hashes(numbers, lang)
            # The remainder of the hash as a signed number, which is what Spark takes.
            bit = np.mod(hashes.view(np.int64), np.int64(bits))
            rare = (frequent[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) == 0
            rare[_END] = True
            flat = np.where(rare[flat], _END, flat)
            padded = np.append(flat, np.zeros(MOST_WORDS, np.int64))
            starts, counts = _distinct(padded, _suffix_starts(flat, count))
            if not len(starts):
                continue
            depth, route = np.full(len(starts), 2, np.int32), np.zeros(len(starts), np.uint64)
            for words, lead in _leads(padded, starts, hashes):
                at = depth == words
                route[at] = lead[at]
                if words < MOST_WORDS:
                    depth[at & hot[words][_slots(lead, width)]] = words + 1
            cell = (route % np.uint64(cells)).astype(np.int64)
            order = np.lexsort((depth, cell))
            starts, counts, depth, cell = starts[order], counts[order], depth[order], cell[order]
            words = padded[starts[:, None] + np.arange(MOST_WORDS)]
            words *= np.minimum.accumulate(words != _END, axis=1)
            # Behind the words of a suffix stands one end.
            shown = np.append(words, np.zeros((len(words), 1), np.int64), axis=1)
            shown = np.append(np.ones((len(words), 1), bool), shown[:, :-1] != _END, axis=1)
            lengths, text_of = shown.sum(axis=1), [*numbers]
            lines = np.append(words, np.zeros((len(words), 1), np.int64), axis=1)[shown]
            ends = np.append(0, np.cumsum(lengths))
            cuts = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(depth) != 0))).tolist()
            out: list[tuple] = []
            held = 0
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                phrases = b" ".join([text_of[i] for i in lines[ends[a] : ends[b]].tolist()])
                several = None if (counts[a:b] == 1).all() else zlib.compress(counts[a:b].astype("<i8").tobytes(), 1)
                packed = pa.compress(phrases, codec="zstd", asbytes=True)
                out.append((int(cell[a]), lang, int(depth[a]), packed, len(phrases), several))
                held += len(packed)
                if held > OUT_BYTES:
                    yield _packed(out)
                    out, held = [], 0
            if out:
                yield _packed(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _gathered(batches):
            yield from rows(lang, texts)

    return docs.mapInArrow(run, _SUFFIXES)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    names = ["cell", "lang", "depth", "phrases", "size", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def sort_suffixes(words: np.ndarray, weight: np.ndarray, floors: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the rows of ``words``, ended by 0s.

    Yields a row, a number of words of two or more and a weight: the rows that start with
    these words weigh so much together. Parts that weigh less than ``floors`` of
    the number of words they differ in are abandoned. Order of rows and results is any.
    """
    depth_of = words.shape[1]
    todo = [(np.arange(len(words)), 0)]
    while todo:
        part, depth = todo.pop()
        key = words[part, depth]
        low, mid, high = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(low, mid), min(max(low, mid), high))
        equal = key == pivot
        if equal.all():
            rest = ()
        else:
            smaller = key < pivot
            rest = (part[smaller], part[~(smaller | equal)])
        for other in rest:
            if len(other) and weight[other].sum() >= floors[depth]:
                todo.append((other, depth))
        if pivot == _END:
            continue
        same = part[equal]
        total = int(weight[same].sum())
        if total < floors[depth]:
            continue
        if depth:
            yield int(same[0]), depth + 1, total
        if depth + 1 < depth_of:
            todo.append((same, depth + 1))


class _Cell:
    """The suffixes of one cell: rows of word numbers and weights, by language and leading words."""

    def __init__(self):
        self.numbers: dict[str, _Numbers] = {}
        self.held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, lang: str, depth: int, phrases: bytes, counts: bytes | None) -> None:
        known = self.numbers.setdefault(lang, _Numbers())
        words = phrases.split(b" ")
        flat = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        ends = np.flatnonzero(flat == _END)
        sizes = np.diff(np.append(-1, ends)) - 1
        rows = np.zeros((len(ends), MOST_WORDS), np.int32)
        rows[np.arange(MOST_WORDS) < sizes[:, None]] = flat[flat != _END]
        weight = np.ones(len(ends), np.int64) if counts is None else np.frombuffer(zlib.decompress(counts), "<i8")
        self.held.setdefault((lang, depth), []).append((rows, weight))

    def mined(self, least: int) -> Iterator[pa.RecordBatch]:
        for (lang, depth), parts in self.held.items():
            text_of = [*self.numbers[lang]]
            words, weight = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            # Rows that lead by ``depth`` words lie elsewhere too for fewer words: no part of those counts is let go.
            floors = [1 if count < depth and depth > 2 else least for count in range(1, MOST_WORDS + 1)]
            found: list[tuple[bytes, int]] = []
            size = 0
            for row, count, total in sort_suffixes(words, weight, floors):
                phrase = b" ".join([text_of[i] for i in words[row, :count].tolist()])
                found.append((phrase, total))
                size += len(phrase)
                if size > OUT_BYTES:
                    yield _counted(lang, found)
                    found, size = [], 0
            if found:
                yield _counted(lang, found)


def _mined(suffixes: DataFrame, least: int) -> DataFrame:
    """Counts of phrases, ``lang``, ``phrase``, ``count``: whole ones of ``least`` or more, and parts of counts.

    Rows come sorted by cell, and one cell is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, _Cell()
        for batch in batches:
            for number, lang, depth, phrases, size, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    yield from cell.mined(least)
                    now, cell = number, _Cell()
                cell.add(lang, depth, pa.decompress(phrases, size, codec="zstd", asbytes=True), counts)
        yield from cell.mined(least)

    return suffixes.mapInArrow(run, "lang string, phrase string, count long")


def _counted(lang: str, found: list[tuple[bytes, int]]) -> pa.RecordBatch:
    phrases, counts = zip(*found)
    columns = [pa.array([lang] * len(found), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string(), safe=False), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "count"])


def phrase_counts(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST_COUNT,
    sketch_counters: int = SKETCH_COUNTERS,
    hot_share: int = HOT_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: words with their counts, and phrases of two to five words with theirs, of ``least`` or more.

    Both have ``lang`` (null as ``und``), ``phrase`` and ``count``; the words also ``n``, the
    occurrences of all words of that language. Null and empty texts have no words.
    """
    docs = df.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    session = df.sparkSession
    profile = settle(_profile(docs, sketch_counters))
    per_word = settle(profile.where(F.col("part").isNull()).groupBy("lang", "word").agg(F.sum("count").alias("count")))
    totals = settle(per_word.groupBy("lang").agg(F.sum("count").alias("n")))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = per_word.where(F.col("count") >= least)
    hot = _hot(profile, sketch_counters, max(1, total // hot_share))
    shared = session.sparkContext.broadcast((_frequent(frequent, FIELD_BITS), hot))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    cells = min(max(CELLS, total // CELL_WORDS), 1 << 30)
    dealt = _suffixes(docs, shared, cells).repartition(parts, "cell").sortWithinPartitions("cell")
    counted = _mined(dealt, least).groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    phrases = settle(counted.where(F.col("count") >= least))
    words = frequent.join(spread(totals, "lang"), "lang").select("lang", F.col("word").alias("phrase"), "count", "n")
    return words, phrases


def _scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every candidate with ``a``, and ``l``, ``r``, ``n`` and ``score`` of its cut that scores lowest.

    A cut's parts are looked up in the counts by the text of the part. The first cut's
    first part is a word, which knows ``n``. Products are decimals, as they may pass 64 bits.
    """
    counts = phrases.withColumn("n", F.lit(None).cast("long")).unionByName(words)
    parted = phrases.withColumn("_words", F.split("phrase", " "))
    size = F.size("_words")
    cuts = parted.select(
        "lang", "phrase", F.col("count").alias("a"), "_words", size.alias("_size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("_first"),
        F.array_join(F.slice("_words", F.col("k") + 1, F.col("_size") - F.col("k")), " ").alias("_rest"),
    )
    first = counts.select("lang", F.col("phrase").alias("_first"), F.col("count").alias("l"), "n")
    rest = counts.select("lang", F.col("phrase").alias("_rest"), F.col("count").alias("r"))
    both = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"])
    of_phrase = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "r")).alias("_cuts"))
    wide = "CAST({} AS DECIMAL(18, 0))"
    score = f"1000 * ({wide.format('a')} * {wide.format('n')}) div ({wide.format('c.l')} * {wide.format('c.r')})"
    lowest = F.expr(f"array_min(transform(_cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r)))")
    return of_phrase.withColumn("_lowest", lowest).select("lang", "phrase", "a", "_lowest.l", "_lowest.r", "n", "_lowest.score")


def _inside(phrases: DataFrame) -> DataFrame:
    """Phrases that lie inside a longer candidate as often as they occur.

    If one lies so inside a phrase that is two words longer, it does inside the one in between as
    well, as that occurs at least as often as the longer. So one word more is all to look at.
    """
    words = F.split("phrase", " ")
    longer = phrases.where(F.size(words) > 2).withColumn("_words", words)
    size = F.size("_words")
    parts = F.array(F.slice("_words", F.lit(1), size - 1), F.slice("_words", F.lit(2), size - 1))
    within = longer.select("lang", F.explode(F.transform(parts, lambda p: F.array_join(p, " "))).alias("phrase"), F.col("count").alias("_longer"))
    most = within.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    return phrases.join(most, ["lang", "phrase"]).where(F.col("_longer") >= F.col("count")).select("lang", "phrase")


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST_COUNT,
    top: int = TOP,
    sketch_counters: int = SKETCH_COUNTERS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are cut into pieces at ``.,;:!?`` and line ends, and pieces into words
    at spaces and tabs; A-Z are lower-cased. A candidate is a phrase of two to
    five words that occurs ``least`` times or more; ``a`` is how often, ``l``
    and ``r`` the counts of the two parts of its lowest-scoring cut, ``n`` the
    words of the language. Candidates inside a longer one that occurs as often
    are left out. Ties in score go by ``a``, then the phrase by its bytes.

    A null ``lang`` counts as ``und``, null and empty texts have no words, rows
    that repeat count as often as they stand there, no rows give none. Other
    columns are left out, whatever their names. A very long text is looked at
    in blocks, and its phrases go on across them.
    """
    words, phrases = phrase_counts(df, text, lang, least, sketch_counters, hot_share)
    left = _scored(words, phrases).join(_inside(phrases), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    numbers = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *numbers)
