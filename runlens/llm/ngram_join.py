"""Jaccard self-join of texts on word shingles, by prefix filters under several token orders.

If two sets have a Jaccard similarity of ``t`` or more, then in any order of
all tokens the first ``n - ceil(t n) + 1`` tokens of each have one in common.
That holds for every order, so a pair must pass it under all of them before
its sets are compared. Orders put frequent tokens last, going by a count sketch
of the corpus, so that common passages seldom stand in a prefix, and break ties
by a different hash each. An order may be any, so the sketch can only cost
time, never a pair. A pair must also pass the nodes' signatures, fields of bits
that tell how far two sets differ at least; only then are texts fetched for it.

The index of the first order is shuffled by token. Comparing everything within
a token would be all pairs of a group of copies. Instead each document is first
compared with one other, the document its prefix tokens most often agree on;
verified links give components, and what is left outside a large one is compared
with a few of its members. Then only documents of different components
whose prefixes have enough tokens in common are compared. So every pair that
could connect something is tested, and a group of any number of near copies
costs a comparison or few for each of them. Documents with equal sets are one
node throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from runlens.llm.components import components
from runlens.llm.session import dismiss, portions, release, settle

SHINGLE_WORDS = 5
#: So many texts are cut into shingles at once.
TEXTS = 250
#: A similarity of PERCENT / 100 or more links.
PERCENT = 75
#: Counters of the token sketch. Driver and workers hold 4 bytes for each (32 MB). More of
#: them tell frequent tokens apart in a larger corpus.
SKETCH_COUNTERS = 1 << 23
#: Bits that mark the nodes whose texts are wanted; workers hold a bit for each.
FIELD_BITS = 1 << 24
#: A node's signature has twice as many bits as the node has tokens, between these bounds.
SIGNATURE_BITS = (1 << 8, 1 << 16)
#: A token that more documents than this have in their prefix is dealt out in parts.
PART_ROWS = 100_000

#: Of the tokens two prefixes must have in common so many are looked for at their front.
FRONT_TOKENS = 3

#: Where a component has this many of a token's nodes, those outside it are first compared
#: with this many of its members each.
LARGE = 32
TRIES = 8

_SKETCH_PART = 1 << 18
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of the token orders: the first one's index is joined, the others filter its pairs.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    x = values ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of each text.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A
    text with fewer words than ``size`` is one shingle, one without words none.
    """
    words = [(t or "").encode().translate(_LOWER).split() for t in texts]
    counts = [len(w) for w in words]
    total = sum(counts)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, total)
    rolled = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + each[k : k + len(rolled)]
    rolled = _mix(rolled, size)
    out, at = [], 0
    for count in counts:
        if count >= size:
            out.append(np.unique(rolled[at : at + count - size + 1]))
        elif count:
            short = np.zeros(1, np.uint64)
            for word in each[at : at + count]:
                short = short * _STEP + word
            out.append(_mix(short, count))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def node_of(shingles: np.ndarray) -> int:
    """A hash of the whole set; documents with equal sets are one node."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)), np.uint64).astype(np.int64))


def least_overlap(n: int) -> int:
    return (PERCENT * n + 99) // 100


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = _common(a, b)
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared) and shared > 0


def signature(shingles: np.ndarray) -> bytes:
    """A bit for each of so many classes of tokens: whether their number is odd."""
    least, most = SIGNATURE_BITS
    bits = min(most, max(least, 1 << (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """How many tokens stand in one of two sets only, at least, by their signatures.

    Each such token turns one bit, so that many differ at most. A longer
    signature folded in halves is the shorter one of the same set.
    """
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = y[:half] ^ y[half:]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_similar(n_x: int, n_y: int, sign_x: bytes, sign_y: bytes) -> bool:
    """False if the signatures show that sets of these sizes do not link."""
    common = -(-PERCENT * (n_x + n_y) // (100 + PERCENT))
    return least_difference(sign_x, sign_y) <= n_x + n_y - 2 * common


@dataclass(frozen=True)
class Frequency:
    """Document frequency by a counter that a token shares with others: never too low."""

    counters: np.ndarray
    usual: float

    @staticmethod
    def slots(tokens: np.ndarray, width: int) -> np.ndarray:
        return (tokens >> np.uint64(40)).astype(np.int64) % width

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.counters[self.slots(tokens, len(self.counters))]

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        """0 for what cannot be told from chance, then one more for each doubling."""
        chance = 4 * np.sqrt(max(1.0, self.usual))
        above = np.maximum((self.of(tokens) - self.usual) / chance, 0.5)
        return np.maximum(0, np.floor(np.log2(above)) + 1).astype(np.uint64)

    def prefixes(self, tokens: np.ndarray, seeds: Sequence[int]) -> list[np.ndarray]:
        """The prefix of a set under each order, as a set.

        A token's place is its class, then its hash.
        """
        if not len(tokens):
            return [tokens for _ in seeds]
        last = prefix_length(len(tokens)) - 1
        classes = self.classes(tokens) << np.uint64(58)
        places = (classes | (_mix(tokens, seed) >> np.uint64(6)) for seed in seeds)
        return [tokens[p <= np.partition(p, last)[last]] for p in places]

    def first(self, tokens: np.ndarray, seed: int) -> np.ndarray:
        """The prefix of a set of at least one token, in the order of that seed."""
        places = (self.classes(tokens) << np.uint64(58)) | (_mix(tokens, seed) >> np.uint64(6))
        return tokens[np.argsort(places, kind="stable")[: prefix_length(len(tokens))]]


_PROFILE = "doc_id long, n int, node long, sign binary, part int, counts binary"


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """One pass: a row with size, node and signature for each document, and the token counts of each task in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(width, np.int32)
        kinds = {"doc_id": pa.int64(), "n": pa.int32(), "node": pa.int64(), "sign": pa.binary(), "part": pa.int32(), "counts": pa.binary()}
        schema = pa.schema(kinds.items())
        for batch in portions(batches, TEXTS):
            sets = shingle_sets(batch.column(1).to_pylist())
            if sets:
                np.add.at(counters, Frequency.slots(np.concatenate(sets), width), 1)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array([signature(s) for s in sets], pa.binary()),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                schema=schema,
            )
        for part in range(0, width, _SKETCH_PART):
            piece = counters[part : part + _SKETCH_PART]
            if piece.any():
                counts = pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())
                none = [pa.nulls(1, t) for t in list(kinds.values())[:4]]
                yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int32()), counts], schema=schema)

    return docs.mapInArrow(run, _PROFILE)


def _frequency(profile: DataFrame, width: int) -> Frequency:
    """The sum of the tasks' counters; parts of fixed number and size reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
                sums[part] = sums[part] + piece if part in sums else piece
        for part, piece in sums.items():
            counts = zlib.compress(np.minimum(piece, 0x7FFFFFFF).astype(np.int32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["part", "counts"])

    parts = profile.where(F.col("part").isNotNull()).select("part", "counts")
    # A task sums the parts it is dealt as they come, so it holds no more than the sketch.
    summed = parts.repartition(F.col("part")).mapInArrow(add, "part int, counts binary")
    counters = np.zeros(width, np.int32)
    for row in summed.toLocalIterator():
        counters[row["part"] : row["part"] + _SKETCH_PART] = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
    return Frequency(counters, float(np.median(counters)))


def _postings(docs: DataFrame, frequency: Broadcast, part_rows: int) -> DataFrame:
    """The index: for every prefix token of every node a row ``token``, ``node``, ``place``, ``part``.

    ``place`` holds the node's size ``n`` and, in its lower 32 bits, the token's place ``at`` in the prefix, from 0:
    all rows of the index are shuffled, and one number takes less than two. ``part`` deals out tokens that very many
    documents have: it counts from 1 for those, and is 0 for a token that is not dealt out. A task names a node
    once, however many copies of it it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = frequency.value, set()
        for batch in portions(batches, TEXTS):
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            for shingles in shingle_sets(batch.column(0).to_pylist()):
                node = node_of(shingles)
                if node in seen or not len(shingles):
                    continue
                seen.add(node)
                first = counts.first(shingles, ORDERS[0])
                parts = np.maximum(1, counts.of(first) // part_rows)
                size = len(first)
                place = (len(shingles) << 32) + np.arange(size, dtype=np.int64)
                values = (first.astype(np.int64), np.full(size, node), place, (node & 0x7FFFFFFF) % parts + (parts > 1))
                for column, value in zip(columns, values):
                    column.append(value)
            if columns[0]:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
                arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=_INDEX)

    return docs.select("text").mapInArrow(run, "token long, node long, place long, part int")


_INDEX = ["token", "node", "place", "part"]


def _n(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _at(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _shared_postings(postings: DataFrame) -> DataFrame:
    """Rows of tokens that two nodes or more have, once for each node.

    Of two nodes that meet, the one that is not larger has the token in front for its own size: the larger the
    other, the fewer places. A token that stands behind that in all of its nodes lets none meet.
    """
    group = Window.partitionBy("token", "part")
    near, n = group.orderBy("node"), _n(F.col("place"))
    rows = postings.withColumn("_last", F.lag("node").over(near)).withColumn("_next", F.lead("node").over(near))
    rows = rows.withColumn("_front", F.max(_in_front(_at(F.col("place")), n, n, n)).over(group))
    once = rows.where(~F.col("node").eqNullSafe(F.col("_last")) & (F.col("_front") | (F.col("part") > 0)))
    # A node whose only neighbour is its own copy may stay; that costs a row and no more. One
    # that is alone in its part may share the token with nodes of other parts.
    return once.where(F.col("_last").isNotNull() | F.col("_next").isNotNull() | (F.col("part") > 0)).select(*_INDEX)


def _common_least(n_x: Column, n_y: Column) -> Column:
    """How many tokens similar sets of these sizes share at least."""
    return F.ceil(PERCENT * (n_x + n_y) / (100 + PERCENT))


def _few(n_x: Column, n_y: Column) -> Column:
    """As :func:`_need`, but few enough that only the front of the prefixes has to be looked at."""
    return F.least(F.lit(FRONT_TOKENS), _need(n_x, n_y))


def _in_front(at: Column, n: Column, n_x: Column, n_y: Column) -> Column:
    """Is this place so far in front that :func:`_few` common tokens of sets of these sizes stand up to it?

    Sets that share at least ``a`` tokens have their ``k`` first common ones
    within the first ``n - a + k`` of each. Texts that have a long passage in
    common, but not enough of it, share tokens only behind that: their own words
    are rarer and come first. So they never meet.
    """
    return at < n - _common_least(n_x, n_y) + _few(n_x, n_y)


def _need(n_x: Column, n_y: Column) -> Column:
    """How many tokens the prefixes of similar sets of these sizes have in common at least.

    The sets share at least ``a`` tokens, so each has at most ``n - a`` that
    the other lacks. The k-th common token thus stands within the prefix of
    both if ``k + n - a`` does not exceed its length.
    """
    return F.greatest(F.lit(1), _common_least(n_x, n_y) + 1 - F.ceil(PERCENT * F.greatest(n_x, n_y) / 100))


def _sizes_fit(n_x: Column, n_y: Column) -> Column:
    return (100 * n_x >= PERCENT * n_y) & (100 * n_y >= PERCENT * n_x)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _best_centre(rows: DataFrame) -> DataFrame:
    """One pair for each node ``x``: with the centre ``y`` that most of its tokens name.

    The centre of a token is its first node by a hash, so that the tokens of a
    group of copies tend to agree on it. It is read off the sorted rows as they
    pass. A token dealt out in parts has a centre in each, and the centres are
    paired with the first of them.
    """
    so_far = Window.partitionBy("token", "part").orderBy(F.xxhash64("node"), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = rows.withColumn("n", _n(F.col("place")))
    named = sized.withColumn("c", F.first(F.struct("node", "n")).over(so_far)).select(
        "token", "part", "node", "n", F.col("c.node").alias("centre"), F.col("c.n").alias("n_c")
    )
    away = named.where(F.col("node") != F.col("centre"))
    votes = away.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"), F.first("n_c").alias("n_c"))
    # The index may lack tokens that are in front of no node.
    likely = votes.where(F.col("votes") >= _few(F.col("n"), F.col("n_c")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "centre"))
    best = likely.withColumn("_rank", rank).where(F.col("_rank") == 1)
    best = best.select(F.col("node").alias("x"), F.col("centre").alias("y"))
    centres = named.where((F.col("part") > 0) & (F.col("node") == F.col("centre"))).groupBy("token").agg(
        F.min("centre").alias("to"), F.max("centre").alias("_last"), F.collect_set("centre").alias("of")
    )
    tied = centres.where(F.col("to") != F.col("_last")).select("to", F.explode("of").alias("centre"))
    tied = tied.where(F.col("to") != F.col("centre")).select(F.col("centre").alias("x"), F.col("to").alias("y"))
    return best.unionAll(tied).distinct()


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of tokens with nodes of different components, with ``component`` and the token's ``main`` one of ``size``.

    A token that is not dealt out in parts is counted where its rows meet. Those of one that is are counted before
    they meet; ``main`` is the same in all of its parts. The rows may be an earlier result for labels since joined.
    """
    rows = shared.select(*_INDEX).join(spread_long(labels, "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    columns = [*_INDEX, "component", "main", "size"]
    token = Window.partitionBy("token")
    same = token.orderBy("component").rangeBetween(Window.currentRow, Window.currentRow)
    whole = rows.where(F.col("part") == 0).withColumn("_c", F.count(F.lit(1)).over(same))
    whole = whole.withColumn("_k", F.count(F.lit(1)).over(token)).withColumn("_main", F.max(F.struct("_c", "component")).over(token))
    whole = whole.where(F.col("_main._c") < F.col("_k")).withColumn("main", F.col("_main.component")).withColumn("size", F.col("_main._c"))
    dealt = rows.where(F.col("part") > 0)
    groups = dealt.groupBy("token", "component").agg(F.count(F.lit(1)).alias("_c"))
    mixed = groups.groupBy("token").agg(F.max(F.struct("_c", "component")).alias("main"), F.count(F.lit(1)).alias("_k"))
    mixed = mixed.where(F.col("_k") > 1).select("token", F.col("main.component").alias("main"), F.col("main._c").alias("size"))
    return whole.select(*columns).unionByName(dealt.join(spread_long(mixed, "token"), "token").select(*columns))


def _tries(held: DataFrame) -> DataFrame:
    """Pairs of nodes outside a token's large component with a few members of it.

    The members are each first by another hash, so a node's tokens tend to name
    the same ones; those named most often are tried.
    """
    large = held.where(F.col("size") >= LARGE)
    inside = large.where(F.col("component") == F.col("main"))
    firsts = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.col("node").alias("y"))).alias(f"m{i}") for i in range(TRIES)]
    members = inside.groupBy("token").agg(*firsts).select("token", F.array(*(F.col(f"m{i}.y") for i in range(TRIES))).alias("ys"))
    outside = large.where(F.col("component") != F.col("main")).select("token", F.col("node").alias("x"))
    named = outside.join(spread_long(members, "token"), "token").select("x", F.explode(F.array_distinct("ys")).alias("y"))
    votes = named.groupBy("x", "y").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("votes"), "y"))
    return votes.withColumn("_rank", rank).where(F.col("_rank") <= TRIES).select("x", "y")


def _across(held: DataFrame) -> DataFrame:
    """Pairs of nodes of different components whose prefixes have enough in common, in front.

    A token's rows outside its largest component are joined with all its rows,
    so the members of that component never meet each other.
    """
    held = held.select("token", "node", _n(F.col("place")).alias("n"), _at(F.col("place")).alias("at"), "component", "main")
    few = held.where(F.col("component") != F.col("main")).select(*(F.col(c).alias(f"{c}_x") for c in ("token", "node", "n", "at", "component")))
    sizes = F.col("n"), F.col("n_x")
    met = held.join(
        few,
        (F.col("token") == F.col("token_x"))
        & (F.col("component") != F.col("component_x"))
        & ((F.col("component") == F.col("main")) | (F.col("node") > F.col("node_x")))
        & _sizes_fit(*sizes)
        & _in_front(F.col("at"), F.col("n"), *sizes)
        & _in_front(F.col("at_x"), F.col("n_x"), *sizes),
    )
    counted = met.groupBy(*_pair("node", "node_x")).agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"), F.first("n_x").alias("n_x"))
    return counted.where(F.col("_c") >= _few(*sizes)).select("x", "y")


def spread_long(df: DataFrame, key: str) -> DataFrame:
    """As :func:`runlens.plans.spread`, for a key that is a long."""
    return df.withColumn(key, F.col(key) + F.lit(0))


def _field(values: DataFrame, bits: int) -> bytes:
    """A bit for each value of a column of longs: a field of fixed size, built by Spark in words of 64 bits."""
    bit = F.pmod(F.col(values.columns[0]), F.lit(bits))
    words = (
        values.select(F.floor(bit / 64).cast("long").alias("word"), (bit % 64).cast("int").alias("at"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    )
    field = np.zeros(bits // 64, np.int64)
    for part in words.toLocalIterator():
        field[part["word"]] = part["bits"]
    return field.tobytes()


def _texts(docs: DataFrame, rows: DataFrame, pairs: DataFrame, bits: int) -> DataFrame:
    """``node`` and one ``text`` of it for the nodes in the pairs, and a few by chance.

    One document stands for each node. Its key tells whether a text need be
    looked at; the text itself tells its node, whatever repeats a key.
    """
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    standing = rows.join(spread_long(nodes, "node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    context = docs.sparkSession.sparkContext
    keys, fields = context.broadcast(_field(standing.select("doc_id"), bits)), context.broadcast(_field(nodes, bits))

    def hit(field: np.ndarray, value: int) -> bool:
        bit = value % bits
        return bool(field[bit >> 3] >> (bit & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, seen = np.frombuffer(keys.value, np.uint8), np.frombuffer(fields.value, np.uint8), set()
        for batch in portions(batches, TEXTS):
            ids = batch.column(0).to_pylist()
            few = batch.column(1).take(pa.array([i for i, key in enumerate(ids) if key is None or hit(known, key)], pa.int64()))
            texts = few.to_pylist()
            out: list[tuple[int, str]] = []
            for text, shingles in zip(texts, shingle_sets(texts)):
                node = node_of(shingles)
                if hit(wanted, node) and node not in seen:
                    seen.add(node)
                    out.append((node, text))
            if out:
                arrays = [pa.array([n for n, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _plausible(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Of pairs ``x``, ``y`` those whose signatures do not rule a link out, settled."""

    def of(name: str) -> DataFrame:
        return signs.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sign").alias(f"sign_{name}"))

    both = pairs.join(of("x"), "x").join(of("y"), "y").select("x", "y", "n_x", "n_y", "sign_x", "sign_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = [may_be_similar(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["x", "y"]).filter(pa.array(may, pa.bool_()))

    return settle(both.mapInArrow(run, "x long, y long"))


def _verified(docs: DataFrame, rows: DataFrame, signs: DataFrame, pairs: DataFrame, frequency: Broadcast, bits: int) -> DataFrame:
    """Of settled pairs ``x``, ``y`` those that link: signatures, all orders' prefixes, then the sets are compared."""
    pairs = _plausible(pairs, signs)
    texts = _texts(docs, rows, pairs, bits)
    of_x = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    # Very many may be paired with one y; the copy of the key lets the join split them.
    of_y = spread_long(texts.select(F.col("node").alias("y"), F.col("text").alias("text_y")), "y")
    both = pairs.join(of_x, "x").join(of_y, "y").select("x", "y", "text_x", "text_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = frequency.value
        known: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

        def of(node: int, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
            if node not in known:
                if len(known) > 200:
                    known.clear()
                (shingles,) = shingle_sets([text])
                known[node] = shingles, counts.prefixes(shingles, ORDERS)
            return known[node]

        for batch in batches:
            links = []
            for x, y, text_x, text_y in zip(*(c.to_pylist() for c in batch.columns)):
                set_y, first_y = of(y, text_y)
                set_x, first_x = of(x, text_x)
                links.append(all(_common(p, q) for p, q in zip(first_x, first_y)) and similar(set_x, set_y))
            kept = batch.select(["x", "y"]).filter(pa.array(links, pa.bool_()))
            yield kept

    links = settle(both.mapInArrow(run, "x long, y long"))
    dismiss(pairs)
    return links


def _grouped(docs: DataFrame, sketch_counters: int, field_bits: int, part_rows: int) -> DataFrame:
    """For every row of ``doc_id`` and ``text`` its ``doc_id``, ``n``, ``node``, ``component`` and ``component_id``.

    ``component`` is a node, ``component_id`` the smallest ``doc_id`` in it,
    which two components may share where it repeats. Rows without shingles
    have neither node nor component and are their own.
    """
    context = docs.sparkSession.sparkContext
    profile = settle(_profile(docs, sketch_counters))
    frequency = context.broadcast(_frequency(profile, sketch_counters))
    documents = profile.where(F.col("part").isNull())
    rows = documents.select("doc_id", "n", "node")
    signs = settle(documents.where(F.col("n") > 0).select("node", "n", "sign").dropDuplicates(["node"]))

    def grouped(links: DataFrame) -> DataFrame:
        release(context)
        return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    shared = settle(_shared_postings(_postings(docs, frequency, part_rows)))
    release(context)
    first = settle(_best_centre(shared))
    links = _verified(docs, rows, signs, first, frequency, field_bits)
    labels = grouped(links)
    held, tried = settle(_mixed(shared, labels)), first.select(*_pair("x", "y"))
    dismiss(shared)
    tries = settle(_tries(held).join(first, ["x", "y"], "left_anti"))
    if not tries.isEmpty():
        links = links.unionAll(_verified(docs, rows, signs, tries, frequency, field_bits))
        labels, tried = grouped(links), tried.unionAll(tries.select(*_pair("x", "y")))
        # Components only grow, so tokens of one component stay such.
        wider, held = held, settle(_mixed(held, labels))
        dismiss(wider)
    across = settle(_across(held).join(tried, ["x", "y"], "left_anti"))
    dismiss(held)
    if not across.isEmpty():
        links = links.unionAll(_verified(docs, rows, signs, across, frequency, field_bits))
        labels = grouped(links)

    classes = rows.where(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("_least"))
    joined = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("_least").alias("component_id"))
    by_node = joined.select("node", "component").join(spread_long(least, "component"), "component").select("node", "component", "component_id")
    # Rows without shingles belong to no node; their key for the join is spread out, as null would not be.
    keyed = rows.withColumn("_node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64("doc_id")))
    of_node = by_node.select((F.col("node") + F.lit(0)).alias("_node"), "component", "component_id")
    return keyed.join(of_node, "_node", "left").select(
        "doc_id",
        "n",
        *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("node", "component")),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sketch_counters: int = SKETCH_COUNTERS,
    field_bits: int = FIELD_BITS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per row of ``df``: ``key`` (a long), ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest key reachable by links, the row's own
    included; texts link when their shingle sets have a similarity of
    :data:`PERCENT` hundredths or more. Null and wordless texts have no
    shingles and link with nothing, not even each other. Rows that repeat link
    if they have words. A null key counts as larger than all others. Other
    columns are left out. Sets are told apart by 64-bit hashes.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _grouped(docs, sketch_counters, field_bits, part_rows)
    return rows.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _with_nodes(df: DataFrame, text: str) -> DataFrame:
    """The rows with ``_node`` added, null for texts without shingles."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, TEXTS):
            nodes = [node_of(s) if len(s) else None for s in shingle_sets(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "_node"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_node", T.LongType())]))


def without_near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sketch_counters: int = SKETCH_COUNTERS,
    field_bits: int = FIELD_BITS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The rows of ``df`` without those that :func:`near_duplicates` links with one that stays.

    Of each component one row of its smallest ``key`` (a long) stays; a null is
    larger than all. Rows without words stay. Where a key stands on one row
    only, the key tells what goes. The rows of keys that repeat, and those
    without a key, are told apart by their texts' nodes; of equal nodes and
    keys the text that sorts first stays.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = settle(_grouped(docs, sketch_counters, field_bits, part_rows))
    gone = rows.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key))
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = settle(counts.where((F.col("_rows") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_key")))
    if repeated.isEmpty():
        return df.join(gone, key, "left_anti").select(*df.columns)
    repeats = F.col(key).eqNullSafe(F.col("_key"))
    once = df.join(repeated, repeats, "left_anti").join(gone, key, "left_anti").select(*df.columns)
    several = _with_nodes(df.join(repeated, repeats, "left_semi").select(*df.columns), text)
    # A component's row: of the nodes with its smallest key the first.
    first = rows.where((F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component").agg(F.min(F.struct("node", "doc_id")).alias("_first"))
    first = first.select(F.col("_first.node").alias("_kept"), F.col("_first.doc_id").alias("_key"))
    kept = several.join(first, (F.col("_node") == F.col("_kept")) & repeats, "left_semi")
    one = kept.groupBy("_node").agg(F.min_by(F.struct(*df.columns), F.col(text)).alias("_row")).select("_row.*")
    return once.unionByName(one).unionByName(several.where(F.col("_node").isNull()).select(*df.columns))
