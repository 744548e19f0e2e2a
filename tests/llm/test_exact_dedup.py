from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from runlens.llm.exact_dedup import duplicate_groups, exact_dedup

SAME_START = "s" * 300
ROWS = [
    (5, "a b", "x"), (3, "a\t\n b", "y"), (9, "a b ", "x"), (4, None, "n"), (8, "", "n"), (7, None, "n"), (2, "a b", "x"),
    (11, SAME_START + "1", "p"), (12, SAME_START + "2", "p"), (13, SAME_START + "1", "p"), (20, "twice", "t"), (20, "twice", "t"),
    (20, "other", "t"), (None, "a b", "k"), (None, "only null", "k"), (None, "only null", "k"), (30, "alone", None), (31, "l" * 50_000, "l"),
    (32, "l" * 50_000, "l"),
]


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _expected(rows):
    """By brute force: rows with their group's key, size and whether they stay."""
    groups = {}
    for key, text, _ in rows:
        groups.setdefault(_norm(text), []).append(key)
    out, seen = [], set()
    for key, text, _ in rows:
        norm = _norm(text)
        keys = groups[norm]
        keep = min((k for k in keys if k is not None), default=None)
        kept = key == keep and (norm, key) not in seen
        seen.add((norm, key))
        out.append((key, keep, len(keys), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, keep_id string, _norm int")


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_groups_equal_brute_force(docs, bits):
    got = Counter(map(tuple, duplicate_groups(docs, digests=True, field_bits=bits).collect()))
    assert got == Counter(_expected(ROWS))


def test_digests_only_where_needed(docs):
    rows = duplicate_groups(docs).collect()
    assert Counter(tuple(r)[:4] for r in rows) == Counter(r[:4] for r in _expected(ROWS))
    assert all(r["text_sha256"] is not None for r in rows if r["group_size"] > 1)
    assert any(r["text_sha256"] is None for r in rows if r["doc_id"] == 30)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_rows_that_stay(docs, bits):
    stay = exact_dedup(docs, field_bits=bits)
    assert stay.columns == docs.columns
    kept = Counter((k, _norm(t)) for (k, t, _), e in zip(ROWS, _expected(ROWS)) if e[3])
    assert Counter((r["doc_id"], _norm(r["text"])) for r in stay.collect()) == kept


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert duplicate_groups(none).count() == 0 and exact_dedup(none).count() == 0


def test_no_python_and_no_texts_in_shuffles(docs):
    plan = duplicate_groups(docs, digests=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
