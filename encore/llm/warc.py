"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header text of
every record is stored separately with that digest. Records are
reconstructed by joining the two. On reading, the digest of every stored
payload is computed again and must equal its address, and the header's
length and payload digest must equal the payload's.

Among records with equal payloads of at least `least_bytes` bytes, the rows
with the largest page_id are the response and all others revisit it (their
block is empty and refers to the response); smaller payloads are all
responses. Null payloads count as empty, null urls as empty; line breaks in a url are
written as a backslash and a letter and come back. A null page_id
is smaller than any other. Rows repeated with the same page_id and payload
are repeated records of the same type. An empty table gives an empty
archive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import land, prepare, shuffles_freed, table

BASE32HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"       # the tables carry no crawl time; a parameter
CODEC = "zstd"                      # of the archive's tables
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 20 bits (5 hex digits) are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32HEX, BASE32)


def address(payload: Column) -> Column:
    """The payload's SHA-256 as bytes: half of what its hexadecimal digits take in every shuffle."""
    return F.unhex(F.sha2(payload, 256))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def one_line(text: Column) -> Column:
    """Backslashes doubled, line breaks as a backslash and a letter."""
    for char, code in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def lines_again(text: Column) -> Column:
    """Undoes `one_line`; doubled backslashes are cut out first, from left to right."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(
        F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def header_text(kind: Column, date: str) -> Column:
    """The exact header of a record, its closing empty line included."""
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", kind), _field("WARC-Record-ID", _id(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", one_line(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _id(F.col("refers_to"))),
                                 _field("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _field("Payload-Length", F.col("bytes")),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))), F.lit("\r\n"))


def write_archive(pages: DataFrame, least_bytes: int = 0, date: str = DATE, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Writes the archive; returns its tables (headers, payloads), read from the shared folder."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    # The tables are read back from their files, so a shuffle is done with once its table is written:
    # those of the payloads, here and on reading, are never on disk together.
    with shuffles_freed(pages.sparkSession):
        sums = land(base.select("page_id", "url", address(F.col("payload")).alias("digest"),
                                sha1_base32(F.col("payload")).alias("sha1"),
                                F.octet_length("payload").cast("long").alias("bytes")), "warc-sums", compression=CODEC)
        first = sums.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
        known = sums.join(first, "digest")
        answers = (F.col("bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("refers_to"))
        kind = F.when(answers, F.lit("response")).otherwise(F.lit("revisit"))
        headers = land(known.select("digest", header_text(kind, date).alias("header")), "warc-headers", compression=CODEC)
        # Any row of a digest has its bytes; copies within a task are dropped before they are shuffled.
        payloads = land(base.select(address(F.col("payload")).alias("digest"), "payload").dropDuplicates(["digest"]),
                        "warc-payloads", compression=CODEC)
    return headers, payloads


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row per record: its fields, its payload and the exact bytes of the record.

    Raises an error if a stored payload does not have its address as digest,
    or a header does not fit its payload.
    """
    def field(name):
        return F.nullif(F.regexp_extract("header", rf"(?md)^{name}: ([^\r]*)\r\n", 1), F.lit(""))

    def page(name):
        return F.nullif(F.regexp_extract("header", rf"(?md)^{name}: <urn:page:([^>]*)>\r\n", 1), F.lit("")).cast("long")

    verified = payloads.select(
        "digest", "payload", F.when(address(F.col("payload")) == F.col("digest"), F.octet_length("payload").cast("long"))
        .otherwise(F.raise_error(F.lit("a stored payload has changed")).cast("long")).alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"))
    parsed = headers.select(
        "digest", "header", page("WARC-Record-ID").alias("page_id"),
        lines_again(F.coalesce(field("WARC-Target-URI"), F.lit(""))).alias("url"),
        field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.concat(field("Payload-Length"), F.lit(" "), field("WARC-Payload-Digest")).alias("said"))
    fits = F.col("said") == F.concat(F.col("payload_bytes").cast("string"), F.lit(" sha1:"), F.col("payload_digest"))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return parsed.join(verified, "digest").select(
        "page_id", "url", "record_type", "refers_to", "payload_digest",
        F.when(fits, F.col("payload_bytes")).otherwise(
            F.raise_error(F.lit("a header does not fit its payload")).cast("long")).alias("payload_bytes"),
        "payload", F.concat(F.col("header").cast("binary"), block, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def read_records(records: DataFrame) -> DataFrame:
    """The fields of every reconstructed `record`, out of its bytes alone.

    Raises an error if the block of a response does not have the length and
    digest that its header states.
    """
    # one character per byte, so places and lengths are those of the bytes
    text = F.decode("record", "ISO-8859-1")
    cut = records.select(text.alias("text")).select(
        F.concat(F.substring_index("text", "\r\n\r\n", 1), F.lit("\r\n")).alias("header"), "text")
    block = F.expr("substring(text, length(header) + 3, length(text) - length(header) - 6)")

    def field(name):
        return F.nullif(F.regexp_extract("header", rf"(?md)^{name}: ([^\r]*)\r\n", 1), F.lit(""))

    def page(name):
        return F.nullif(F.regexp_extract("header", rf"(?md)^{name}: <urn:page:([^>]*)>\r\n", 1), F.lit("")).cast("long")

    out = cut.select(
        page("WARC-Record-ID").alias("page_id"), field("Payload-Length").cast("long").alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        F.encode(block, "ISO-8859-1").alias("block"))
    good = (F.col("record_type") == "revisit") | (
        (F.octet_length("block") == F.col("payload_bytes")) & (sha1_base32(F.col("block")) == F.col("payload_digest")))
    return out.withColumn("record_type", F.when(good, F.col("record_type")).otherwise(
        F.raise_error(F.lit("a record's block does not fit its header")).cast("string")))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    headers, payloads = write_archive(table(spark, sf_dir, "pages"))
    return read_records(read_archive(headers, payloads).select("record")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), b AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32
    AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""
