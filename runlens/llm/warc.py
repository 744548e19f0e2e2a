"""WARC archives of pages: written in segments, read back by putting the segments together.

Writing and reading are column functions; only the chunked transfer framing is
decoded in Python, record by record. Archives go through Spark's text source
with the record boundary as line separator, so readers stream records and never
hold a file. The writer sees to it that no block contains the boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from runlens.llm.exact_dedup import candidates
from runlens.llm.session import settle
from runlens.plans import spread

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
BOUNDARY = CRLF * 2
#: Between two records: the end of one and the version line of the next.
SEPARATOR = f"{BOUNDARY}{VERSION}{CRLF}"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Blocks longer than this are written as a record and its continuations.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10


def payload_digest(payload: Column) -> Column:
    """The SHA-1 in base32: 10 hexadecimal digits are 40 bits are 8 characters."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _raw(binary: Column) -> Column:
    """Bytes as a string of the same bytes, which string functions concatenate and the text source writes."""
    return binary.cast("string")


def _cut(binary: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(binary) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(binary, s + 1, F.lit(size)))


def _chunked(payload: Column) -> Column:
    """A text in chunked transfer framing; a chunk ends inside any version line the text may hold."""
    parts = F.split(payload, r"(?<=WARC)(?=/1\.1\r\n)")
    chunks = F.filter(
        F.flatten(F.transform(parts, lambda p: _cut(p.cast("binary"), CHUNK_BYTES))), lambda c: F.octet_length(c) > 0
    )
    framed = F.transform(
        chunks, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), _raw(c), F.lit(CRLF))
    )
    return F.concat(F.array_join(framed, ""), F.lit(f"0{BOUNDARY}"))


def _lines(*headers: tuple[str, Column | str]) -> Column:
    """Header lines, the empty line included; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit(CRLF)) for k, v in headers]
    return F.concat_ws("", F.lit(VERSION + CRLF), *lines, F.lit(CRLF))


def _decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with their payload, ``_keep`` (the key of the response) and ``_nth`` among rows alike.

    Pages whose payload may occur twice are told by length and start; only
    those are shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select("page_id", "url", payload.alias("_text"), F.sha2(payload, 256).alias("_sha"))
    rows = candidates(named.withColumn("_page", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))), F.col("_text"))
    again = F.col("_again") & (F.octet_length("_text") >= least_bytes)
    columns = ["page_id", "url", "_text", "_sha"]
    alone = rows.where(~again).select(*columns, F.lit(False).alias("_shared"), F.lit(None).cast("long").alias("_keep"))
    several = rows.where(again).select(*columns, "_page")
    keys = several.groupBy("_sha", "page_id", "_page").agg(F.count(F.lit(1)).alias("_rows"))
    keep = keys.groupBy("_sha").agg(F.min("page_id").alias("_keep"))
    of = keys.join(spread(keep, "_sha"), "_sha").select("_sha", "_page", "_keep", F.lit(True).alias("_shared"))
    together = several.join(of, ["_sha", "_page"])
    nth = F.row_number().over(Window.partitionBy("_sha", "_page").orderBy("url"))
    # Pages alone still need numbers where a row repeats below the least size.
    return together.withColumn("_nth", nth).drop("_page").unionByName(alone.withColumn("_nth", F.monotonically_increasing_id() + (1 << 40)))


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """The WARC records of ``pages`` (``page_id``, ``url``, ``html``), one row each in ``value``.

    A null page is an empty payload. Of pages with equal payloads of at least
    ``least_bytes`` bytes that with the smallest id becomes the response, the
    first by url if that id repeats; the others become revisits. A null id is
    larger than all others. Other columns are left out.
    """
    rows = _decided(pages, least_bytes)
    revisit = F.coalesce(F.col("_shared"), F.lit(False)) & ~(
        F.col("page_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)
    )

    def name(page: Column, nth: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), F.col("_sha"), F.lit(":"), nth, F.lit(">"))

    http = F.lit(CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", "")))
    block = F.when(revisit, http).otherwise(F.concat(http, _chunked(F.col("_text"))))
    rows = rows.select(
        "page_id",
        # Line ends in a url would end its header.
        F.regexp_replace("url", r"[\r\n]", " ").alias("url"),
        revisit.alias("_revisit"),
        name(F.col("page_id"), F.col("_nth").cast("string")).alias("_id"),
        F.when(revisit, name(F.col("_keep"), F.lit("1"))).alias("_refers"),
        payload_digest(F.col("_text").cast("binary")).alias("_digest"),
        block.cast("binary").alias("_block"),
    )
    rows = rows.withColumn("_segments", _cut(F.col("_block"), SEGMENT_BYTES)).withColumn("_count", F.size("_segments"))
    each = rows.select("*", F.posexplode("_segments").alias("_i", "_segment"))
    first, several, last = F.col("_i") == 0, F.col("_count") > 1, F.col("_i") == F.col("_count") - 1
    kind = F.when(~first, "continuation").when(F.col("_revisit"), "revisit").otherwise("response")
    head = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.when(first, F.col("_id")).otherwise(F.concat(F.expr("left(_id, length(_id) - 1)"), F.lit("/"), F.col("_i"), F.lit(">")))),
        ("WARC-Date", date),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Page-ID", F.col("page_id").cast("string")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("_digest")))),
        ("WARC-Profile", F.when(F.col("_revisit"), F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.col("_refers")),
        ("WARC-Segment-Number", F.when(several, (F.col("_i") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("_id"))),
        ("WARC-Segment-Total-Length", F.when(several & last, F.octet_length("_block").cast("string"))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length("_segment").cast("string")),
    )
    return each.select(F.concat(head, _raw(F.col("_segment"))).alias("value"))


def write_archives(values: DataFrame, path: str) -> None:
    """Record rows as gzip archives in a shared folder, which must not exist."""
    values.write.option("lineSep", BOUNDARY).option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(path)


def _header(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def _apart(value: Column) -> Column:
    """The records in what the text source gives as one.

    Its reader misses a separator that begins on one side of its buffer's end
    and ends on the other where line ends stand in front, as they do behind a
    chunked body. All string functions used here go by bytes.
    """
    missed = F.octet_length(value) - F.octet_length(F.replace(value, F.lit(SEPARATOR), F.lit("")))
    each = F.transform(
        F.sequence(F.lit(1), F.floor(missed / len(SEPARATOR)).cast("int") + 1),
        lambda i: F.call_function("substring_index", F.call_function("substring_index", value, F.lit(SEPARATOR), i), F.lit(SEPARATOR), F.lit(-1)),
    )
    return F.when(F.contains(value, F.lit(SEPARATOR)), each).otherwise(F.array(value))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, each with its headers and its ``block`` of the stated length.

    A record shorter than it states, cut off or split by a version line inside
    a block that another writer left there, is an error, never left out.
    """
    text = spark.read.option("lineSep", SEPARATOR).text(path).select(F.explode(_apart(F.col("value"))).alias("value"))
    head = F.concat(F.substring_index("value", BOUNDARY, 1), F.lit(CRLF))
    rows = text.where(F.length("value") > 0).select(head.alias("_head"), F.col("value").cast("binary").alias("_value"))
    length = _header(F.col("_head"), "Content-Length").cast("int")
    body = F.substring(F.col("_value"), F.octet_length("_head") + len(CRLF) + 1, length)
    whole = F.octet_length(body) == length
    return rows.select(
        _header(F.col("_head"), "WARC-Type").alias("type"),
        _header(F.col("_head"), "WARC-Record-ID").alias("record_id"),
        _header(F.col("_head"), "WARC-Target-URI").alias("url"),
        _header(F.col("_head"), "WARC-Page-ID").cast("long").alias("page_id"),
        _header(F.col("_head"), "WARC-Payload-Digest").alias("stated_digest"),
        _header(F.col("_head"), "WARC-Refers-To").alias("refers_to_id"),
        _header(F.col("_head"), "WARC-Segment-Number").cast("int").alias("segment"),
        _header(F.col("_head"), "WARC-Segment-Origin-ID").alias("origin_id"),
        _header(F.col("_head"), "WARC-Segment-Total-Length").cast("long").alias("total"),
        F.when(whole, body).otherwise(F.raise_error(F.concat(F.lit("record is cut: "), "_head"))).alias("block"),
    )


def reassemble(read: DataFrame) -> DataFrame:
    """Records with whole blocks: those in segments are put together by origin, number and stated total.

    Segments meet only those of their own record. A missing or repeated
    segment, or a wrong total, is an error.
    """
    fields = ("type", "url", "page_id", "stated_digest", "refers_to_id")
    single = read.where(F.col("segment").isNull()).select("record_id", *fields, "block")
    parts = read.where(F.col("segment").isNotNull())
    inside = F.array_sort(F.collect_list(F.struct("segment", "block")))
    origin = F.coalesce("origin_id", "record_id")
    grouped = parts.groupBy(origin.alias("record_id")).agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(f))).alias(f) for f in fields),
        inside.alias("_parts"),
        F.max("total").alias("_total"),
    )
    joined = F.array_join(F.transform("_parts", lambda p: _raw(p["block"])), "").cast("binary")
    numbers = F.transform("_parts", lambda p: p["segment"])
    right = (F.octet_length(joined) == F.col("_total")) & (numbers == F.sequence(F.lit(1), F.size("_parts")))
    block = F.when(right, joined).otherwise(F.raise_error(F.concat(F.lit("segments do not fit: "), "record_id")))
    return single.unionByName(grouped.select("record_id", *fields, block.alias("block")))


def dechunk(body: bytes) -> bytes:
    """The content of a chunked body; a body that ends early or states a wrong size is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2 + size
        if size == 0:
            return b"".join(out)
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2 : at])
        at += 2


def http_payload(block: bytes, headers_only: bool) -> bytes | None:
    """What an HTTP response carries, its transfer framing decoded; null for a revisit, which carries none."""
    if headers_only:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(
        k.strip().lower() == b"transfer-encoding" and v.strip().lower().endswith(b"chunked")
        for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])
    )
    return dechunk(body) if chunked else body


def payloads(whole: DataFrame) -> DataFrame:
    """The records with ``payload`` in place of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("type")).to_pylist()
            blocks = batch.column(batch.num_columns - 1).to_pylist()
            out = pa.array([http_payload(b, k == "revisit") for b, k in zip(blocks, kinds)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "payload"])

    schema = T.StructType([*whole.schema.fields[:-1], T.StructField("payload", T.BinaryType())])
    return whole.mapInArrow(run, schema)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page, revisits resolved by the record they refer to.

    ``page_id``, ``payload_bytes`` and ``payload_digest`` of the full payload,
    ``record_type`` and ``refers_to``. A response whose payload does not have
    the digest it states is an error.
    """
    read = payloads(reassemble(read_archives(spark, path)))
    digest = payload_digest(F.col("payload"))
    checked = F.when(F.concat(F.lit("sha1:"), digest) == F.col("stated_digest"), digest).otherwise(
        F.raise_error(F.concat(F.lit("payload is not what its digest says: "), "record_id"))
    )
    rows = settle(
        read.select(
            "record_id",
            "page_id",
            "type",
            "refers_to_id",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("type") == "response", checked).alias("payload_digest"),
        )
    )
    responses = rows.where(F.col("type") == "response")
    origin = responses.select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    revisits = rows.where(F.col("type") == "revisit").select("page_id", "type", "refers_to_id").join(origin, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select(*columns))
