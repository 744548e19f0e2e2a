"""Queries without SQL against the libraries, or brute force, over whole small tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from runlens.llm import queries
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library_ids(documents):
    encode = Tokenizer.from_file(queries.BYTE_BPE).encode
    return {k: encode(t, add_special_tokens=False).ids for k, t in documents.items()}


def _packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_token_counts(spark, documents):
    encode = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE).encode
    expected = {k: (len(t.encode()), len(encode(t)), len(encode(t)) > 4096) for k, t in documents.items()}
    rows = queries.op4_token_counts(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == expected and len(rows) == len(expected)


def test_ids_and_decoded_texts(spark, library_ids):
    decode = Tokenizer.from_file(queries.BYTE_BPE).decode
    expected = {
        k: (len(ids), hashlib.sha256(_packed(ids)).hexdigest(), hashlib.sha256(decode(ids, skip_special_tokens=False).encode()).hexdigest())
        for k, ids in library_ids.items()
    }
    rows = queries.op6_bpe(spark, SF_DIR).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == expected and len(rows) == len(expected)


def test_packed_sequences(spark, library_ids):
    rows = queries.op7_pack(spark, SF_DIR).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, ids in library_ids.items():
        whole, expected, start = [*ids, 0], [], 0
        length = (len(whole) - 1) % 2048 + 1
        while start < len(whole):
            expected.append((len(expected), start, length, zlib.crc32(_packed(whole[start : start + length]))))
            start, length = start + length, 2048
        assert sorted(pieces[k]) == expected
    for held in places.values():
        ends = [0, *np.cumsum([length for _, length in sorted(held)]).tolist()]
        assert [offset for offset, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    least = -(-sum(len(ids) + 1 for ids in library_ids.values()) // 2048)
    assert least <= len(places) <= least * 1.02 + 1


def test_warc_records(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    expected = {
        k: (
            len(html),
            base64.b32encode(hashlib.sha1(html).digest()).decode(),
            "response" if first[html] == k else "revisit",
            None if first[html] == k else first[html],
        )
        for k, html in pages.items()
    }
    rows = queries.op5_warc(spark, SF_DIR).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == expected and len(rows) == len(expected)
