"""Content-addressed web archive.

An archive is a folder of two Parquet tables:

* ``payloads`` - every distinct payload once: digest (SHA-256, hex), ``sha1``,
  ``bytes`` and ``frame``, the payload as one zstd frame;
* ``records`` - one row per record in capture order fields: the exact WARC header
  block (named fields, CRLF line ends) and the digest of its payload.

Equal payloads are found by narrow rows (digests and ids), never by moving the
payloads together: a payload that a third of all pages share folds map-side to one
row per task.  Reading joins headers to payloads by digest, checks the digest and
the length of the bytes that come back, and rebuilds the record byte by byte.

``Content-Length`` is the length of the record's block - 0 for a revisit, whose payload stands
elsewhere - and ``X-Payload-Length`` that of the payload, so a plain WARC file
(:func:`warc_text`) can be read record by record.  ``WARC-Date`` comes from a column, or is one
stated instant.  A url with line ends is written percent-encoded (``%`` too) and the record says so
(``X-Target-URI-Escaped``), so every url comes back as it was; all others are written as they are.
The records' type words are those of the archive's contract: a general reader will take a
``response`` with a text/html block for what the standard calls a resource.

Nulls: a null payload is the empty payload; a null url gives an empty
``WARC-Target-URI``; a null page id is written as an empty id and loses to any
other as the group's response (when all are null, every record is a response).
Repeated rows of the responding id are responses too - never a revisit of itself.
Very long payloads are one value each, as in the input; they are never joined together.
An empty table gives empty tables.  Only the named columns are read.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads below this many bytes are always stored as responses.
REVISIT_MIN_BYTES = 1000
CRLF = "\r\n"
#: Date of records whose capture time is not known.
CAPTURED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line."""
    return F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(CRLF))


_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _url_fields(url: Column) -> Column:
    """The target line, and a mark where line ends had to be percent-encoded to keep it one line."""
    escaped = url
    for plain, code in _ESCAPES:
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    odd = F.coalesce(url.contains("\r") | url.contains("\n"), F.lit(False))
    return F.concat(_field("WARC-Target-URI", F.when(odd, escaped).otherwise(url)),
                    F.when(odd, _field("X-Target-URI-Escaped", F.lit("percent"))).otherwise(F.lit("")))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = REVISIT_MIN_BYTES, date_col: str | None = None,
                  date: str = CAPTURED) -> None:
    """Write ``pages`` as an archive under ``path`` (a folder all executors share).  ``date_col`` is a timestamp
    column (UTC); where there is none, or no value, a record is dated ``date``."""
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    when = F.lit(date) if date_col is None else F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), when.alias("date"), body.alias("payload"))
    p = p.select("page_id", "url", "date", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
                 F.octet_length("payload").cast("long").alias("bytes"))
    # the strong digest is verified by a second one and the length: they are grouped together
    key = ["digest", "sha1", "bytes"]
    owner = p.groupBy(*key).agg(F.max("page_id").alias("owner"))
    r = p.join(owner, key)
    revisit = (F.col("bytes") >= min_bytes) & (F.col("owner") != F.col("page_id"))
    revisit = F.coalesce(revisit, (F.col("bytes") >= min_bytes) & F.col("owner").isNotNull())
    kind = F.when(revisit, "revisit").otherwise("response")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _field("WARC-Type", kind), _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        _field("WARC-Date", F.col("date")), _url_fields(F.col("url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", _record_id(F.col("owner"))),
                                 _field("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("X-Payload-Length", F.col("bytes")),
        _field("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("bytes"))))
    r.select("page_id", head.alias("header"), "digest").write.parquet(f"{path}/records")

    full = pages.select(body.alias("payload"))
    full = full.select(F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
                       F.octet_length("payload").cast("long").alias("bytes"), _packed("payload").alias("frame"))
    # equal payloads fold in the tasks that read them, before anything moves
    full.groupBy(*key).agg(F.first("frame").alias("frame")).write.parquet(f"{path}/payloads")


@F.pandas_udf(T.BinaryType())
def _packed(payloads: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor().compress
    return payloads.map(lambda b: pack(bytes(b)))


@F.pandas_udf(T.BinaryType())
def _unpacked(frames: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor().decompress
    return frames.map(lambda b: unpack(bytes(b)))


def _named(name: str) -> Column:
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload): every record with its payload, which for a revisit is
    that of the response it refers to.  A payload whose bytes do not have the
    header's digest and length stops the read."""
    h = spark.read.parquet(f"{path}/records")
    p = spark.read.parquet(f"{path}/payloads")
    r = h.join(p, "digest", "left").withColumn("payload", _unpacked("frame"))
    whole = (F.sha2("payload", 256) == F.col("digest")) & (F.sha1("payload") == F.col("sha1")) & (
        F.octet_length("payload") == F.col("bytes"))
    checked = F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), "digest")).cast("binary"))
    return r.select("page_id", "header", checked.alias("payload"))


def record_fields(records: DataFrame, *keep: str) -> DataFrame:
    """The parsed header fields of each record, beside the columns in ``keep``."""
    refers, url = _named("WARC-Refers-To"), _named("WARC-Target-URI")
    plain = url
    for char, code in reversed(_ESCAPES):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return records.select(
        *keep, _named("WARC-Type").alias("record_type"), F.when(_named("X-Target-URI-Escaped") == "percent", plain).otherwise(url).alias("url"),
        F.substring(_named("WARC-Payload-Digest"), 6, 40).alias("header_sha1"),
        F.when(refers == "", None).otherwise(F.regexp_extract(refers, r"<urn:page:([^>]*)>", 1)).alias("refers_to"),
        _named("WARC-Date").alias("date"), _named("Content-Length").cast("long").alias("content_length"),
        _named("X-Payload-Length").cast("long").alias("payload_length"))


def warc_text(records: DataFrame) -> DataFrame:
    """Each record as WARC text without the closing two line ends: write it with
    ``.write.option("lineSep", "\\r\\n\\r\\n").text(path)`` to get plain WARC files."""
    body = F.when(_named("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    return records.select(F.concat("header", F.lit(CRLF), body).alias("value"))
