"""A corpus pipeline: from documents to sequences of tokens.

Each stage takes all that its predecessor kept. A run writes every stage's rows
as Parquet to the folder in ``spark.checkpoint.dir`` and reads them again, so
lineage is cut between stages and any lost task is redone from files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import bpe, exact_dedup, langid, ngram_join, packing, pii
from runlens.llm.queries import BYTE_BPE, PSEUDONYM_KEY, SEQUENCE_LENGTH
from runlens.llm.session import empty, ready
from runlens.plans import checkpoint_dir

#: What a worker of the last stage takes at once and remembers: executors are full of what earlier stages left.
PACK_ROWS, PACK_REMEMBERED = 250, 32 << 20
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, in ``lang``: only those without any letters go.

    The language found in the text is written into ``lang``, whether or not
    there was a label; the model is fitted on the labels of all documents, and
    one that disagrees with what is found is replaced. If no document has a
    label there is no model, and ``lang`` stays null.
    """
    ready(spark)
    model = langid.fit(docs)
    found = langid.identify(docs.select(*DOCUMENT), model)
    if model is None:
        return found.where(F.col("text").rlike(r"\p{L}")).select(*DOCUMENT)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*DOCUMENT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    ready(spark)
    return exact_dedup.exact_dedup(docs.select(*DOCUMENT))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles one with the smallest id, whether or not ids repeat or are missing."""
    ready(spark)
    return ngram_join.without_near_duplicates(docs.select(*DOCUMENT))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; the texts' lengths follow."""
    ready(spark)
    done = pii.pseudonymise(docs.select(*DOCUMENT), PSEUDONYM_KEY)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    ready(spark)
    pieces = packing.pieces(bpe.encode(docs, BYTE_BPE, rows=PACK_ROWS, remembered=PACK_REMEMBERED), SEQUENCE_LENGTH)
    items = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, SEQUENCE_LENGTH, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_duplicates", near),
    ("pii", pseudonyms),
    ("pack", pack),
]

#: The stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = f"{checkpoint_dir(ready(spark))}/pipeline-{uuid.uuid4()}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            # No later stage reads what went into this one: an empty table takes its place.
            empty(docs).write.mode("overwrite").parquet(read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return docs
