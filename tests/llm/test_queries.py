"""The registered queries of the text operators, and the pipeline, over whole small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from runlens.llm import bpe, langid, packing, pii, queries
from tests.compare import connect, differences
from tests.conftest import SF_DIR
from tests.llm.test_exact_dedup import _norm
from tests.llm.test_similarity import brute_force


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_duckdb(spark, name):
    assert differences(queries.queries()[name](spark, SF_DIR), connect(SF_DIR), queries.oracle_sql()[name]) == []


def test_all_operators_and_the_pipeline_are_registered():
    names = registered.text_queries()
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])


def test_rows_of_the_other_queries(spark):
    for name, table in (("op1_language_id", "documents"), ("op4_token_counts", "documents"), ("op5_warc", "pages"), ("op6_bpe", "documents"), ("op8_pii", "documents")):
        rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
        assert queries.queries()[name](spark, SF_DIR).count() == rows, name


def test_the_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lettered = [(k, t) for k, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for k, t in sorted(lettered):
        first.setdefault(_norm(t), (k, t))
    once = list(first.values())
    kept = {k for k, _, component in brute_force(once) if k == component}
    replace = pii.Pseudonyms(queries.PSEUDONYM_KEY).replace
    sizes = {k: len(bpe.vocabulary(queries.BYTE_BPE).encode([replace(t)[0]])[0]) // 4 + 1 for k, t in once if k in kept}
    packed = corpus_pipeline.run(spark, SF_DIR)
    got = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == sizes
    pieces = {}
    for n in sizes.values():
        first_piece, more = (n - 1) % queries.SEQUENCE_LENGTH + 1, (n - 1) // queries.SEQUENCE_LENGTH
        for size, count in ((first_piece, 1), (queries.SEQUENCE_LENGTH, more)):
            pieces[size] = pieces.get(size, 0) + count
    bins = packing.plan({s: n for s, n in pieces.items() if n}, queries.SEQUENCE_LENGTH).bins
    assert packed.select("sequence_id").distinct().count() == bins


def test_stages_take_empty_tables_nulls_and_more_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, more int"
    for rows in ([], [(1, None, None, None, None, 1), (None, "some words here", "en", "s", 3, 1), (2, "some words here", None, "s", 3, 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "pack":
                assert docs.columns == corpus_pipeline.DOCUMENT
        assert docs.select("doc_id").distinct().count() == (1 if rows else 0)


def test_near_duplicates_where_ids_repeat(spark):
    words = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    texts = [" ".join(w) for w in words]
    close = [" ".join([*w[:-1], "end"]) for w in words]
    rows = [
        (1, texts[0]), (1, texts[1]), (2, close[0]), (2, texts[2]), (3, close[1]),  # 2 stands on a near copy and on a text of its own
        (4, texts[3]), (4, close[3]), (4, texts[3].upper()),  # a group whose smallest id repeats
        (5, "..."), (5, ""), (5, "..."), (None, close[2]), (None, "no words like these"), (None, None), (6, "only one"),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, SF_DIR).collect()]
    fours = [t for k, t in got if k == 4]
    assert len(fours) == 1 and fours[0] in (texts[3].upper(), close[3])
    expected = [rows[i] for i in (0, 1, 3, 8, 9, 10, 12, 13, 14)]
    # One word or more is a shingle, so equal texts of these rows are one.
    expected.remove((5, "..."))
    assert sorted((r for r in got if r[0] != 4), key=repr) == sorted(expected, key=repr)


def test_the_language_found_is_the_language_written(spark):
    english, german = "the weather was good and they went with the others", "das wetter war gut und sie gingen mit den anderen"
    rows = [(i, f"{english} {i}", "en") for i in range(40)] + [(100 + i, f"{german} {i}", "de") for i in range(40)]
    rows += [(200, english, "de"), (201, german, None), (202, german, "de")]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, SF_DIR).collect()}
    assert got == {k: "de" if t.startswith(german) else "en" for k, t, _ in rows}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert [r["lang"] for r in corpus_pipeline.language(spark, unlabelled, SF_DIR).collect()] == [None] * len(rows)


def test_no_letters_go_and_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "...", None, "s", 3), (2, "one small text", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF_DIR).collect()] == [2]
    assert langid.UNKNOWN == "und"
