"""A content-addressed WARC archive.

Payload bytes are stored once, gzip members named by the SHA-256 of what they hold; every record keeps its own
exact header lines in a table beside them.  Copies of a payload collapse before they are shuffled, and only what is
kept is packed.  A record is its headers joined to the payload of that digest: reading back rebuilds the bytes of
every record so, and takes all that it returns from those bytes.  A stored payload whose digest is not its name, and a
record whose block is not what its headers say, are errors.

Of records with equal payloads the one with the smallest page_id is the response, the others revisit it.

Behaviour: a null html is an empty payload, and empty payloads are deduplicated like others; rows repeated
under one page_id with one payload are the same record and all responses; a row without a page_id is a
revisit of its payload's response, or a response if no row with that payload has an id; a null url is written as an
empty target; identical rows share one record, which is read back as often as it was written; records that share
an id but not a payload have names of their own, since a name ends in the payload's digest; an empty table gives an
empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import HOT_SHARE, SLICE_ROWS, Scratch, join_hot

#: Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX, HEX32, BASE32 = 5, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LEVEL = 4


def base32(digest_hex: Column) -> Column:
    """The upper-case base32 of 40 hexadecimal digits: five of them are four characters."""
    parts = [F.lpad(F.conv(F.substring(digest_hex, 1 + HEX * i, HEX), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def record_headers(pages: DataFrame, date: str, scratch: Scratch) -> DataFrame:
    """sha256, stored (whether the payload follows), headers (the exact block) and times of each record.

    Pages are read once; what follows works on a table of their digests.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.sha2(payload, 256).alias("sha256"),
        base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("length"),
    )
    rows = scratch.save(rows, "digests")
    groups = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    named = join_hot(rows, groups, "sha256", "n", rows.count())
    response = F.coalesce(F.col("page_id") == F.col("first_id"), F.col("first_id").isNull())
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.col("sha256"), F.lit(">"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(response, F.concat(F.lit("WARC-Block-Digest: sha256:"), F.col("sha256"))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_id")))),
        F.when(~response, F.lit(f"WARC-Profile: {IDENTICAL}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("length")).otherwise(F.lit(0)).cast("string")),
    ]
    headers = named.select("sha256", response.alias("stored"), F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).alias("headers"))
    return headers.groupBy("headers").agg(F.first("sha256").alias("sha256"), F.first("stored").alias("stored"), F.count("*").alias("times"))


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            names, body = (batch.slice(at, SLICE_ROWS).column(c).to_pylist() for c in ("sha256", "payload"))
            for name, x in zip(names, body, strict=True):
                _verify(name, x)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([_gzip(x) for x in body], pa.binary())], names=["sha256", "body"])


def _gzip(payload: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(payload) + packer.flush()


def _verify(name: str, payload: bytes) -> bytes:
    if hashlib.sha256(payload).hexdigest() != name:
        raise ValueError(f"stored payload {name} is damaged")
    return payload


def write_archive(spark: SparkSession, pages: DataFrame, scratch: Scratch, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Writes both tables and returns (headers, payloads): headers, sha256, stored, times; sha256, body."""
    headers = scratch.save(record_headers(pages, date, scratch), "headers")
    scratch.drop("digests")
    raw = pages.select(F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    # the rows of one digest are equal: each task passes one of them on, and one of those is packed
    kept = raw.groupBy("sha256").agg(F.first("payload").alias("payload"))
    return headers, scratch.save(kept.mapInArrow(_deflate, "sha256 string, body binary"), "payloads")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            rows = zip(*(part.column(c).to_pylist() for c in ("sha256", "headers", "body")), strict=True)
            made = [h.encode() + (b"" if body is None else _verify(name, zlib.decompress(body, 31))) + b"\r\n\r\n" for name, h, body in rows]
            yield pa.RecordBatch.from_arrays([part.column("sha256"), part.column("times"), pa.array(made, pa.binary())], names=["sha256", "times", "record"])


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """sha256, times and the bytes of every record that was written, once for identical ones; a revisit's block is empty.

    Only responses are joined to payloads.  A digest with at least HOT_SHARE of them (records without an id, or of one
    id and many addresses) is salted over as many tasks as it fills even shares.
    """
    stored = headers.where("stored")
    counts = stored.groupBy("sha256").agg(F.count("*").alias("n"))
    least = max(2, int(stored.count() * HOT_SHARE))
    salts = F.broadcast(counts.where(F.col("n") >= least).select("sha256", F.ceil(F.col("n") / least).cast("int").alias("salts")))
    one = F.coalesce("salts", F.lit(1))
    left = stored.join(salts, "sha256", "left").withColumn("salt", F.pmod(F.xxhash64("headers"), one).cast("int")).drop("salts")
    right = payloads.join(salts, "sha256", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    columns = ["sha256", "headers", "times", "body"]
    whole = left.join(right, ["sha256", "salt"]).select(*columns)
    empty = headers.where("not stored").withColumn("body", F.lit(None).cast("binary")).select(*columns)
    return whole.unionByName(empty).mapInArrow(_rebuild, "sha256 string, times long, record binary")


PARSED = "sha256 string, times long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of records to their fields; a response's length and digest are those of its block."""

    def page(name: str | None) -> int | None:
        number = name.split(":")[2] if name else "none"
        return None if number == "none" else int(number)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part, out = batch.slice(at, SLICE_ROWS), []
            for sha256, times, record in zip(*(part.column(c).to_pylist() for c in ("sha256", "times", "record")), strict=True):
                head, _, rest = record.partition(b"\r\n\r\n")
                version, *lines = head.decode().split(CRLF)
                field = dict(x.split(": ", 1) for x in lines)
                block, end = rest[: int(field["Content-Length"])], rest[int(field["Content-Length"]) :]
                claimed, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
                size = digest = None
                if kind == "response":
                    size, digest = len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()
                if version != VERSION or end != b"\r\n\r\n" or digest not in (None, claimed):
                    raise ValueError(f"record {field['WARC-Record-ID']} is not what its headers say")
                out.append((sha256, times, page(field["WARC-Record-ID"]), kind, page(field.get("WARC-Refers-To")), size, claimed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_archive(headers: DataFrame, payloads: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the records' bytes.

    A revisit has the length and digest of the response that it refers to, which must be the digest that it claims.
    """
    parsed = scratch.save(records(headers, payloads).mapInArrow(_parse, PARSED), "parsed")
    found = parsed.where("record_type = 'response'").groupBy("sha256").agg(F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    groups = found.join(parsed.groupBy("sha256").agg(F.count("*").alias("n")), "sha256")
    joined = join_hot(parsed, groups, "sha256", "n", parsed.count())
    wrong = F.raise_error(F.concat(F.lit("wrong digest in headers of "), F.col("sha256"))).cast("string")
    honest = F.when(F.col("payload_digest") == F.col("digest"), F.col("digest")).otherwise(wrong)
    each = joined.select("page_id", F.col("bytes").alias("payload_bytes"), honest.alias("payload_digest"), "record_type", "refers_to", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.drop("col")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archive of all pages to the shared folder, then reads it back."""
    scratch = Scratch(spark, "warc")
    headers, payloads = write_archive(spark, pages, scratch)
    return read_archive(headers, payloads, scratch)


#: Fixed text: the result of op3 in SQL.
ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), d AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS b32
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id OR first_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM d
"""
