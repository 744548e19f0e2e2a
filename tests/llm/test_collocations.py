from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from runlens.llm import collocations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, count int, phrase string"


def plainly(rows: list[tuple[str | None, str | None]], least: int, top: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, b in candidates.items():
            parts = {q[i : i + m] for m in range(2, len(q)) for i in range(len(q) - m + 1)}
            inside |= {p for p in parts if 100 * b >= 100 * f[p]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def _mine(spark, rows, least, top, **how):
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, collocations.collocations(df.repartition(5), least=least, top=top, **how).collect()))


def _corpus(seed: int, docs: int) -> list[tuple[str | None, str | None]]:
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "漢", "NEW", "york", "city", "<a>", " ", "\x1c", "b\0c", "...", "x" * 50]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "]
    rows = []
    for _ in range(docs):
        text = "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(60)))
        rows.append((text, draw.choice(["en", "en", "en", None, "und", ""])))
    return rows


@pytest.mark.parametrize("how", [{}, {"sketch_counters": 8}, {"hot_share": 30}, {"hot_share": 10**9}])
def test_equals_brute_force(spark, how):
    rows = [*_corpus(1, 150), (None, "en"), ("", None), ("a a a a a a a", "rep"), ("a a a a a a a", "rep"), ("one", "single")]
    for least, top in ((5, 40), (2, 3)):
        assert _mine(spark, rows, least, top, **how) == plainly(rows, least, top)


def test_one_pair_and_one_document_hold_most_words(spark, monkeypatch):
    draw = random.Random(2)
    rare = [f"w{i}" for i in range(300)]
    rows = [(f"very common {draw.choice(rare)} {draw.choice(rare)}", "en") for _ in range(600)] + [("copy of one text", "en")] * 500
    rows.append((" ".join(draw.choice(["long", "text", "without", "end"]) for _ in range(3000)), "en"))
    assert _mine(spark, rows, 20, 2000) == plainly(rows, 20, 2000)


def test_blocks_do_not_show(monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["aa", "b", "ccc", "d.", "e,"]) for _ in range(400)).encode(), b"x" * 500, b"", b"a b c d e f g"]

    def suffixes():
        found = Counter()
        for flat, count, numbers in collocations._words(texts):
            names, padded = [*numbers], np.append(flat, np.zeros(5, np.int64))
            for at in collocations._suffix_starts(flat, count).tolist():
                words = [names[i] for i in padded[at : at + 5].tolist()]
                found[tuple(words[: words.index(b"\n")] if b"\n" in words else words)] += 1
        return found

    whole = suffixes()
    for size in (7, 30, 200):
        monkeypatch.setattr(collocations, "BLOCK", size)
        assert suffixes() == whole


def test_the_sort_counts_what_a_dictionary_counts():
    draw = np.random.default_rng(7)
    words = draw.integers(1, 6, (3000, 5)).astype(np.int32)
    words[draw.random(3000) < 0.3, 3:] = 0
    weight = draw.integers(1, 4, 3000)
    counts = Counter()
    for row, times in zip(words.tolist(), weight.tolist()):
        row = row[: row.index(0)] if 0 in row else row
        counts.update({tuple(row[:m]): times for m in range(2, len(row) + 1)})
    for least in (1, 40):
        got = {tuple(words[row, :m].tolist()): total for row, m, total in collocations.sort_suffixes(words, weight, [least] * 5)}
        assert got == {p: c for p, c in counts.items() if c >= least}


def test_empty_tables(spark):
    assert _mine(spark, [], 2, 5) == []
    assert _mine(spark, [(None, None), ("", "en"), ("...", "en")], 2, 5) == []
