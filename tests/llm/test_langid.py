from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other thing happened with this"
DE = "der schnelle braune fuchs springt über den faulen hund und dann geschah noch etwas anderes"
RU = "быстрая коричневая лиса перепрыгивает через ленивую собаку и потом случилось другое"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, name) for i, (t, name) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)]
    rows += [(50, None, "en"), (51, "text without a label", None), (None, EN, "en")]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(5)
    for rows in (1, 2, 7, 40, 333):
        scores, starts = rng.normal(size=(rows, 3)), rng.random(rows) < 0.1
        starts[0] = True
        labels = langid.viterbi(scores, starts, 1.5)

        def total(path):
            jumps = [(a != b) and not s for a, b, s in zip(path, path[1:], starts[1:])]
            return scores[np.arange(rows), path].sum() - 1.5 * sum(jumps)

        best = np.zeros(3)
        for k in range(rows):
            best = np.maximum(best, best.max() - (0 if starts[k] else 1.5)) + scores[k]
        assert np.isclose(total(labels), best.max())


def test_spans_of_a_mixed_text(model):
    text = f"{EN}. {DE}! {RU}"
    ((lang, score, spans),) = model.label([text])
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert [text[s["start"] : s["end"]] for s in spans] == [EN, DE, RU]
    assert 0.3 < score < 0.5 and lang in ("en", "de", "ru")


def test_scripts_narrow_candidates(model):
    ((lang, score, _),) = model.label(["лисаfox"])
    assert lang == "ru" and score == 1.0


def test_rows(spark, model):
    rows = [(1, EN, "x"), (1, EN, "x"), (2, None, "x"), (3, "", "x"), (4, "123 _ .,²½", "x"), (None, DE, "x"), (5, "漢字", "x"), (6, EN + " " + DE * 300, "x")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model)
    found = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert sorted(found, key=repr)[:2] == [(1, "en"), (1, "en")]
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "de"), (6, "de")} <= set(found) and dict(found)[5] in model.languages
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    assert langid.fit(df) is None
    assert [r["lang_pred"] for r in langid.identify(df, None).collect()] == ["und"]


def test_held_out_accuracy(spark):
    from runlens.llm.queries import op1_language_id

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = op1_language_id(spark, sf_dir).where("held_out").join(docs, "doc_id")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert total > 200 and right / total > 0.98


def test_forgetting_words_changes_nothing(model, monkeypatch):
    texts = [EN, DE, RU, EN + DE] * 3
    expected = model.label(texts)
    monkeypatch.setattr(langid, "REMEMBERED", 3)
    assert [model.label([t])[0] for t in texts] == expected

def test_memory_does_not_grow_with_the_batch(spark, model, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = langid.identify(df, model)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": [f"{EN} {DE} " * 3] * 2000})
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and most < 12 * batch.nbytes, most / batch.nbytes
