from __future__ import annotations

from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from runlens.llm import bpe, packing
from runlens.llm.queries import BYTE_BPE


def _bins(counts, capacity):
    """Lay every item out by the plan; the fill of each bin."""
    plan = packing.plan(counts, capacity)
    laid = defaultdict(list)
    for size, n in counts.items():
        sequence, offset = plan.places(np.full(n, size), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            laid[s].append((o, size))
    for items in laid.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(laid) == plan.bins
    return sorted(sum(size for _, size in items) for items in laid.values())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plans_are_gapless_and_no_two_bins_could_be_one(counts):
    fills = _bins(counts, 60)
    assert sum(fills) == sum(s * n for s, n in counts.items())
    assert len(fills) < 2 or fills[0] + fills[1] > 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(21, 60), max_size=9))
def test_large_items_are_matched_best(sizes):
    """Above a third only pairs fit; no matching has more of them."""
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1

    def most(left):
        if not left:
            return 0
        a, rest = left[0], left[1:]
        options = [most(rest)]
        options += [1 + most(rest[:i] + rest[i + 1 :]) for i in range(len(rest)) if a + rest[i] <= 60]
        return max(options)

    assert len(_bins(dict(counts), 60)) == len(sizes) - most(tuple(sorted(sizes)))


def test_nothing_to_plan():
    assert packing.plan({}, 10).bins == 0


def test_packing_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 300, 5: "x" * 500, 6: "a b c", 7: "hot", 8: "hot", 9: "hot"}
    rows = [*texts.items(), (9, "hot"), (None, "no key"), *((k, "hot") for k in range(100, 140))]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, length int")
    pieces = packing.pieces(bpe.encode(df, BYTE_BPE), 64)
    packed = packing.pack(pieces, 64, ["doc_id", "piece"]).collect()
    vocabulary = bpe.vocabulary(BYTE_BPE)
    whole = {k: vocabulary.encode([t])[0] + b"\0\0\0\0" for k, t in rows}
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in packed:
        assert bytes(r["ids"]) == whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_document[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(spans)]).tolist()]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 64
    for key, parts in by_document.items():
        parts = sorted(set(parts))
        assert sum(n for *_, n in parts) == len(whole[key]) // 4
        assert all(n == 64 for piece, _, n in parts if piece > 0)
    assert len(packed) == sum(-(-len(whole[k]) // 4 // 64) for k, _ in rows)
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(pieces, 64, ["doc_id", "piece"])).collect()}
    assert sum(map(len, joined.values())) == sum(len(whole[k]) for k, _ in rows) and max(map(len, joined.values())) <= 256


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(bpe.encode(none, BYTE_BPE), 64), 64, ["doc_id"]).count() == 0
