"""The queries of this package, over whole tables, and SQL for those it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import ann, bpe, chat, collocations, exact_dedup, fim, langid, ngram_join, packing, pii, sharding, token_counts, warc
from runlens.llm.session import table
from runlens.plans import checkpoint_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
SEQUENCE_LENGTH = 2048
NEIGHBOURS = 5
SHARDS = 24
#: Of these queries only; a real run takes its own secret.
PSEUDONYM_KEY = b"the key of the registered queries"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those not held out.

    Null texts and texts without letters are `und`; rows that repeat come out alike; no rows give none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back.

    Null texts and roles are empty; equal turn numbers go by role, then text, null first; of no rows only conversation -7 is left.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(trap).alias("text"),
    )
    formatted = chat.format_chats(chat.canonical_turns(rows.unionByName(extra)))
    read = formatted.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts.

    Null counts as empty; the smallest id of a group stays; no rows give none.
    """
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), digests=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every text.

    Null has none; special strings are ordinary text; rows that repeat come out alike; no rows give none.
    """
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back.

    Null is an empty payload; of equal payloads the smallest id is the response; no rows give none.
    """
    pages = table(spark, sf_dir, "pages")
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_archives(warc.records(pages), path)
    return warc.page_records(spark, path)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again.

    Null is the empty text and has no ids; rows that repeat come out alike; no rows give none.
    """
    ids = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    digest = ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(digest, BYTE_BPE).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed.

    A null or empty text is the end id alone; rows that repeat are packed each; no rows give none.
    """
    pieces = packing.pieces(bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE), SEQUENCE_LENGTH)
    items = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, SEQUENCE_LENGTH, ["doc_id", "piece", "ids_crc32"])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced.

    Null stays null; equal values have equal pseudonyms; rows that repeat stay equal; no rows give none.
    """
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document.

    Null and wordless texts are alone, with no shingles; equal texts with words link; no rows give none.
    """
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every fiftieth id.

    Null, zero and non-finite vectors take no part; ties go to the smaller id; no rows give none.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), NEIGHBOURS)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged and rebuilt; null texts are empty, rows that repeat come out alike, no rows give none."""
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the law ``rows``.

    Null texts have a size of 8 and the checksum of nothing, a null source is a
    source of its own, rows that repeat are rows like others, no rows give none.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(bytearray()))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", size, crc)
    sharded = sharding.interleave(rows, SHARDS)
    none = F.lit(None).cast("int").alias("grown_shard")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language; null texts have no words, a null language is ``und``, no rows give none."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_format": op2_chat_format,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_warc": op5_warc,
        "op6_bpe": op6_bpe,
        "op7_pack": op7_pack,
        "op8_pii": op8_pii,
        "op9_ngram_join": op9_ngram_join,
        "op10_ann": op10_ann,
        "op11_fim": op11_fim,
        "op12_shards": op12_shards,
        "op13_collocations": op13_collocations,
    }


_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<turn >') + 2 + length(role) + length(text) + length('</turn>') + 1
      + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM texts
"""

_OP3 = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM texts WINDOW w AS (PARTITION BY text_sha256)
"""


_OP5 = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), base32 AS (
  SELECT page_id, payload_bytes, digest,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
      ((('0x' || substr(digest, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest
  FROM payloads
), placed AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM base32
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM placed
"""

_OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    list_transform(range(4), lambda i: ('0x' || substr(sha256('1:' || doc_id), 1 + 8 * i, 8))::BIGINT) AS h
  FROM documents
), placed AS (
  SELECT doc_id, text, units, len(units) AS n,
    least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS p, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS q,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:p], ''), '') AS prefix,
    coalesce(array_to_string(units[p + 1:q], ''), '') AS middle, coalesce(array_to_string(units[q + 1:n], ''), '') AS suffix
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
), grams AS (
  SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM starts
), counted AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), often AS (
  SELECT * FROM counted WHERE f >= 100
), cuts AS (
  SELECT lang, phrase, f, m, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM often WHERE m > 1
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, t.n,
    CAST(1000::HUGEINT * c.f * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, sub, max(f) AS f FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1:m - 1], ' ') AS sub FROM often WHERE m > 2
    UNION ALL SELECT lang, f, array_to_string(string_split(phrase, ' ')[2:m], ' ') FROM often WHERE m > 2
  ) GROUP BY lang, sub
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.sub = s.phrase WHERE coalesce(i.f, 0) < s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": _OP2,
        "op3_exact_dedup": _OP3,
        "op5_warc": _OP5,
        "op9_ngram_join": _OP9,
        "op11_fim": _OP11,
        "op13_collocations": _OP13,
    }
