from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

from runlens.llm import fim, queries
from tests.conftest import SF_DIR

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plainly(key, text: str | None) -> tuple:
    """What the contract says, in so many words."""
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def test_the_query_equals_brute_force(spark):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for r in texts:
        n, form, prefix, middle, output = plainly(r["doc_id"], r["text"])
        expected[r["doc_id"]] = (n, form, prefix, middle, _digest(output), _digest(r["text"] or ""))
    rows = queries.op11_fim(spark, SF_DIR).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == expected and len(rows) == len(texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_any_text_in_any_batch(spark):
    draw = random.Random(3)
    pieces = ["<P>", "<S>", "<M", "<", ">", "S>", "<<", "word", "Z", "é", "漢字", "😀", " ", "\n", "\r\n", "\0", "7", "a<"]
    rows = [(i, "".join(draw.choices(pieces[2:], k=draw.randrange(30)))) for i in range(400)]
    rows += [(i, "".join(draw.choices(pieces, k=5))) for i in range(400, 450)]
    rows += [(500, None), (501, ""), (None, "no key at all"), (-5, "below zero"), (502, "same"), (502, "same"), (503, "x y" * 400_000)]
    df = spark.createDataFrame([(k, t, i, "") for i, (k, t) in enumerate(rows)], "doc_id long, text string, n int, output string")
    got = fim.restore(fim.transform(df)).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(((k, *plainly("" if k is None else k, t)) for k, t in rows), key=repr)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)


def test_rotations_undo_themselves():
    draw = random.Random(5)
    for _ in range(200):
        data = bytes(draw.randrange(256) for _ in range(draw.randrange(1, 40)))
        start, cut, end = sorted(draw.randrange(len(data) + 1) for _ in range(3))
        buffer = bytearray(data)
        fim.rotate(buffer, start, cut, end)
        assert bytes(buffer) == data[:start] + data[cut:end] + data[start:cut] + data[end:]
        fim.rotate(buffer, start, start + end - cut, end)
        assert bytes(buffer) == data


def test_chances_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(i, "some text here") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in fim.transform(df, chances=fim.Chances(0, 0)).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(df, chances=fim.Chances(100, 100)).collect()} == {"spm"}
    assert fim.restore(fim.transform(df.limit(0))).collect() == []
    with pytest.raises(ValueError, match="restored"):
        fim.restore(fim.restore(fim.transform(df)))
