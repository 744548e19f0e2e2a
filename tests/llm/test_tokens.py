"""BPE encoding and decoding and token counts against the tokenizer libraries."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from runlens.llm import bpe
from runlens.llm.queries import BYTE_BPE, PIECE_BPE
from runlens.llm.session import dismiss, settle
from runlens.llm.token_counts import WordCounts, token_counts

ODD = [
    "", " ", "  ", "a  b", " a", "a ", "\n a\n\n b  \n", "aaaa aaaaaaaaaaa", "x<|endoftext|>y <|endoftext|> z", "<|endoftext|>",
    "日本語テキスト 한국어", "\x1c \x1d a \x85b", "a b　c", "\0a \0 b", "\1x \1<|endoftext|>", "don't I'll we've'd",
    "▁a ▁▁b▁", "<s> </s> <unk> <0x0A>", "é é", "a\r\nb\tc", "🙂🙃 ok", "﻿x",
]


def _random_texts(n: int) -> list[str]:
    rnd = random.Random(7)
    letters = list("ab \n\t'stdm.,19éß日  　\x1c\0\1<|>▁")
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [*ODD, *_random_texts(3000), *(r["text"] for r in rows)]


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs.load(BYTE_BPE)


def test_ids_and_texts_equal_the_library(pairs, texts):
    theirs = Tokenizer.from_file(BYTE_BPE)
    for text, ids in zip(texts, pairs.encode(texts)):
        expected = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert pairs.decode(ids) == theirs.decode(expected, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(pairs, texts, monkeypatch):
    whole = pairs.encode(texts[:300])
    for name, value in (("REMEMBERED_BYTES", 3000), ("GROUP_CHARS", 500), ("GROUP_BYTES", 40), ("LONG_STRETCH", 5), ("MEND_RADIUS", 1)):
        monkeypatch.setattr(bpe, name, value)
        forgetful = bpe.BytePairs.load(BYTE_BPE)
        assert [forgetful.encode(texts[i : i + 30]) for i in range(0, 300, 30)] == [whole[i : i + 30] for i in range(0, 300, 30)], name
        assert forgetful._memory.bytes <= bpe.REMEMBERED_BYTES


def test_rows_and_memory_are_bounded_where_asked(spark, pairs, texts, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = bpe.encode(df, BYTE_BPE, rows=7, remembered=3000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts[:300]})
    ids, seen = [], []
    for part in run(iter([batch])):
        ids += part.column(1).to_pylist()
        seen.append((part.num_rows, bpe.vocabulary(BYTE_BPE)._memory.bytes))
    assert ids == pairs.encode(texts[:300])
    assert max(rows for rows, _ in seen) == 7 and 0 < max(held for _, held in seen) <= 3000


def test_dismissed_tables_need_no_python_worker(spark, monkeypatch):
    kept = settle(spark.range(5).selectExpr("id", "struct(array(binary('x')) AS a) AS s"))
    (folder,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}

    def refuse(*_, **__):
        raise AssertionError("rows from the driver start Python workers of their own")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    dismiss(kept)
    assert spark.read.schema(kept.schema).parquet(folder).count() == 0


def test_long_words_without_spaces(pairs):
    draw = random.Random(8)
    cjk = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    texts = ["".join(draw.choices(cjk, k=20_000)), "a" * 30_000, "ab" * 9000, "".join(draw.choices("abcdefghij0123+/", k=20_000)), "the" * 7000, "😀é" * 4000]
    texts += ["".join(draw.choices("tehaionsr", k=5000)), "x " * 30_000 + "".join(draw.choices(cjk, k=300)) * 9]
    theirs = Tokenizer.from_file(BYTE_BPE)
    start = time.process_time()
    ours = pairs.encode(texts)
    spent = time.process_time() - start
    for text, ids in zip(texts, ours):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text[:20]
    assert spent < 10


def test_the_heap_merges_as_the_rounds_do(pairs, texts):
    words = [t.encode() for t in texts[:400] if t]
    for word, merged in zip(words, pairs.merge([w[:500] for w in words])):
        assert pairs._merge_long(word[:500]).tolist() == merged.tolist()


def test_verification_finds_exactly_the_borders_that_merge(pairs):
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 50256, (2, 4000))
    good = pairs.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist()):
        (merged,) = pairs.merge([pairs.bytes_of[x] + pairs.bytes_of[y]])
        assert (merged.tolist() == [x, y]) == ok


def test_every_token_encodes_to_itself_or_is_never_proposed(pairs):
    tokens = [t for t in pairs.bytes_of[:50256]]
    merged = pairs.merge(tokens)
    proposed = set(pairs._token_at[pairs._token_at >= 0].tolist())
    assert proposed == {i for i, m in enumerate(merged) if m.tolist() == [i]}


def test_decoding_bytes_that_are_no_text(pairs):
    half = pairs.merge(["é".encode()[:1]])[0].astype("<u4").tobytes()
    assert pairs.decode(half) == "�" and pairs.decode(b"") == pairs.decode(None) == ""


def test_encoding_in_spark(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, "y"), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, BYTE_BPE), BYTE_BPE)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "one two"), (1, "one two"), (None, ""), (2, "")], key=repr)
    assert bpe.encode(df.limit(0), BYTE_BPE).count() == 0


def test_counts_equal_the_library(texts):
    counts, theirs = WordCounts(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for text in texts:
        assert counts.count(text) == len(theirs.encode(text)), repr(text)
    assert len(counts.proved) > 10_000


def test_counts_in_spark(spark):
    df = spark.createDataFrame([(1, "one two", 5), (None, None, 6), (3, "é", 7), (3, "é", 7)], "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, token_counts(df, PIECE_BPE).collect()), key=repr)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    assert out == sorted([(1, 7, len(theirs.encode("one two"))), (None, 0, 0), *[(3, 2, len(theirs.encode("é")))] * 2], key=repr)
    assert token_counts(df.limit(0), PIECE_BPE).count() == 0


def test_a_long_word_and_a_long_text(pairs):
    theirs = Tokenizer.from_file(BYTE_BPE)
    for text in ("ab" * 5000, "word " * 50_000):
        (ids,) = pairs.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_files_stand_outside_the_repository():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
