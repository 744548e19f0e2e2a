"""Components, the n-gram join and nearest neighbours against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import ann, ngram_join
from runlens.llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_components(spark, kind):
    rnd = random.Random(2)
    links = {
        "random": [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)],
        "path": [(i, i + 1) for i in rnd.sample(range(64), 64)],
        "star": [(50, i) for i in range(50)] + [(50, i) for i in range(10)],
        "loops": [(1, 1), (2, 3), (3, 2), (4, 4), (4, 5)],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame([*links, (None, 7)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(union({x for p in links for x in p}, links).items())


def shingles(text):
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """Sorted (key, size, component) of every row, null keys as infinitely large."""
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if (k := len(sets[i] & sets[j])) and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k)
    ]
    group = union(range(len(rows)), links)
    least = {}
    for i, (key, _) in enumerate(rows):
        known = least.get(group[i])
        least[group[i]] = key if known is None else known if key is None else min(known, key)
    return sorted(((k, len(s), least[group[i]]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def _random_documents(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    common = " ".join(rnd.choices(words, k=30))
    bases = [rnd.choices(words, k=rnd.choice((3, 7, 20, 60, 120))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 2, 4, 8))):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, rnd.choice((" ", "\n", "  ")).join(text).title() + (f" {common}" if rnd.random() < 0.3 else "")))
    return rows


EDGES = [
    (200, None), (201, ""), (202, " \t "), (203, "one"), (204, "ONE"), (205, "a b c d e"), (206, "a b c d e f"), (207, "A B C D E"), (208, " x y"),
    (None, "a b c d e"), (210, "same row"), (210, "same row"), (211, "é É"), (212, "É É"), (None, None),
]


@pytest.mark.parametrize("seed, part_rows", [(1, 100_000), (2, 2)])
def test_ngram_join_equals_brute_force(spark, seed, part_rows):
    rows = [*_random_documents(seed), *EDGES]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, node string")
    got = ngram_join.near_duplicates(df, sketch_counters=1 << 13, field_bits=1 << 12, part_rows=part_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_a_node_alone_in_a_part_of_its_tokens(spark):
    """Copies in one part of all their tokens, and their only near copy alone in the other."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:-1], f"e{i}"]) for i in range(40)]
    part = [ngram_join.node_of(s) & 1 for s in ngram_join.shingle_sets(texts)]
    rows = [(i, texts[part.index(1)]) for i in range(5)] + [(9, texts[part.index(0)])]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch_counters=1 << 13, part_rows=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_a_large_group_whose_members_differ(spark, monkeypatch):
    """Copies with so many edits that many are near some of the others only."""
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    monkeypatch.setattr(ngram_join, "TRIES", 3)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rnd.randint(0, 7)):
            text[rnd.randrange(150)] = f"e{rnd.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch_counters=1 << 13)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_a_chain_that_only_its_links_connect(spark):
    """Each document is near the next one only, and shares its frequent words with all."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(17)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch_counters=1 << 13)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_ngram_join_on_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=repr) == brute_force(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(only_empty).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_of_similar_sets_meet_under_any_order():
    rng = np.random.default_rng(1)
    frequency = ngram_join.Frequency(rng.integers(0, 500, 1024).astype(np.int32), 3.0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)]))
        if len(b) and ngram_join.similar(a, b):
            for p, q in zip(frequency.prefixes(a, ngram_join.ORDERS), frequency.prefixes(b, ngram_join.ORDERS)):
                common = -(-75 * (len(a) + len(b)) // 175)
                need = common + 1 - ngram_join.least_overlap(max(len(a), len(b)))
                assert len(np.intersect1d(p, q)) >= max(1, need)


def _index(spark, rows):
    """Rows of the index from token, node, size, place in the prefix, and part."""
    return spark.createDataFrame([(t, node, (n << 32) + at, part) for t, node, n, at, part in rows], "token long, node long, place long, part int")


def test_tokens_that_let_no_nodes_meet_are_not_kept(spark):
    """Sets of 100 that link have three common tokens within the first 17 of each; a larger one has to be met by a smaller one in front."""
    rows = [(1, 7, 100, 3, 0), (1, 8, 100, 24, 0), (2, 7, 100, 17, 0), (2, 8, 100, 24, 0), (3, 7, 100, 0, 0), (4, 7, 100, 17, 0), (4, 9, 80, 13, 0), (5, 7, 100, 20, 2)]
    got = ngram_join._shared_postings(_index(spark, rows))
    assert sorted({(r["token"], r["node"]) for r in got.collect()}) == [(1, 7), (1, 8), (4, 7), (4, 9), (5, 7)]
    # The larger the other set, the fewer places in front: a set's own size bounds them.
    least = lambda n, m: -(-75 * (n + m) // 175)
    front = lambda n, m: n - least(n, m) + min(3, max(1, least(n, m) + 1 - ngram_join.least_overlap(max(n, m))))
    assert front(100, 100) == 17 and all(front(n, m) <= front(n, n) for n in range(1, 400) for m in range(n, n * 4 // 3 + 1))


def test_tokens_of_several_components(spark):
    """Whether or not tokens are dealt out, in one shuffle of the rows by token, and again from what is left."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    rows = [(t, node, 9, 0, part and 1 + node % 2) for t, part in ((10, 0), (11, 1)) for node in (1, 2, 3, 5)]
    rows += [(t, node, 9, 0, part and 1 + node % 2) for t, part in ((20, 0), (21, 1)) for node in (3, 4)]
    held = ngram_join._mixed(_index(spark, rows), labels)
    shown = sorted((r["token"], r["node"], r["component"], r["main"], r["size"]) for r in held.collect())
    assert shown == [(t, node, c, 1, 2) for t in (10, 11) for node, c in ((1, 1), (2, 1), (3, 3), (5, 5))]
    joined = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 1)], "node long, component long")
    assert ngram_join._mixed(held, joined).count() == 0


def test_signatures_never_rule_out_what_links():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for i in range(400):
        n = int(rng.choice((1, 4, 40, 150, 600, 3000)))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice((0.5, 0.8, 0.9, 0.97))], rng.integers(0, 1 << 62, int(n * rng.choice((0, 0.1, 0.4)))).astype(np.uint64)]))
        if not len(b):
            continue
        signs = ngram_join.signature(a), ngram_join.signature(b)
        assert ngram_join.least_difference(*signs) <= len(np.setxor1d(a, b))
        may = ngram_join.may_be_similar(len(a), len(b), *signs)
        assert may or not ngram_join.similar(a, b)
        ruled_out += not may
    assert ruled_out > 100
    # Sizes far apart: the longer signature is folded to the shorter one's length.
    small, large = np.arange(3, dtype=np.uint64), np.arange(3000, dtype=np.uint64)
    assert len(ngram_join.signature(small)) < len(ngram_join.signature(large))
    assert ngram_join.least_difference(ngram_join.signature(small), ngram_join.signature(large)) <= 2997
    assert ngram_join.least_difference(ngram_join.signature(large), ngram_join.signature(large)) == 0


def _exact(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q in queries:
            scored = [(-float(ann.cosine(v[None], w[None])[0]), i) for i, w in usable if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


VECTORS = "vec_id long, vector array<float>, cell int"


def test_search_of_every_cell_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(120, 200)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None, *[1.0] * 7]), (304, [float("inf")] * 8), (305, [1e-30] * 8), (306, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    asked = {0, 50, 100, 150, 300, 301, 305}
    got = _found(ann.search(df, df.where(F.col("vec_id").isin(*asked)), share=1.0, centroids=4))
    expected = _exact(rows, asked, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=0, atol=1e-12) for q in got)


def test_recall_on_the_test_vectors(spark):
    from runlens.llm.queries import op10_ann

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = _exact(rows, {i for i, _ in rows if i % 50 == 0}, 5)
    got = _found(op10_ann(spark, sf_dir))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in expected.items())
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (None, [1.0, 0.5], 0)], VECTORS)
    assert {q: [i for i, _ in v] for q, v in _found(ann.search(two, two)).items()} == {0: [1], 1: [0]}


def test_the_heap_visits_cells_in_order():
    index = ann.MultiIndex(np.array([[0.0], [1.0], [3.0]]), np.array([[0.0], [2.0]]), np.ones(6, np.int64))
    vector = np.array([0.6, 0.8])
    cells = index.probes(vector, 6)
    cost = [(index.first[c // 2, 0] - 0.6) ** 2 + (index.second[c % 2, 0] - 0.8) ** 2 for c in cells]
    assert sorted(cells) == list(range(6)) and cost == sorted(cost)
    assert len(index.probes(vector, 2)) == 2
