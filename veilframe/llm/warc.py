"""WARC archives: records written with segments and chunked transfer framing, read back and reassembled.

Writing is built-in functions only.  Equal payloads (by SHA-1) are stored once: the row with the smallest
id is the response, the others are revisits that refer to it.  A block longer than a segment becomes a
response record and continuation records.  Spark's text writer commits the files, so any store that
Spark reaches will do and a lost executor leaves no half archive.

Reading parses each file by the records' own lengths, groups continuation records by the identifier of
their origin, orders them by segment number, verifies numbering and total length, strips the HTTP head
and decodes the chunks.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_broadcast, written
from veilframe.session import shared_folder

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 65536, 8192, 1000
CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"
# The digits of base 32, as Spark's conv writes them and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "file string, record_type string, record_id string, uri string, segment int, origin string, "
    "total_length long, refers_to string, payload_digest string, block binary, error string")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32."""
    hexed = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), CONV_DIGITS, BASE32_DIGITS)


def chunked(body: Column, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """A binary column in chunked transfer framing."""
    last = F.floor((F.length(body) - 1) / chunk_bytes).cast("int")
    piece = lambda i: F.substring(body, i * chunk_bytes + 1, F.lit(chunk_bytes))
    chunks = F.when(F.length(body) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(
        F.lower(F.hex(F.length(piece(i)).cast("long"))), F.lit(CRLF), piece(i).cast("string"), F.lit(CRLF)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(chunks, ""), F.lit(f"0{CRLF}{CRLF}")).cast("binary")


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(row, id, url, payload, digest, first): ``first`` is the record id of the response a revisit refers to.

    Payloads of fewer than ``least_bytes`` bytes are never revisits.  A null payload is empty; of rows with
    equal ids the one that is read first is the response, a null id comes last.
    """
    rows = written(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
        .withColumn("digest", base32_sha1(F.col("payload"))), "warc-rows")
    named = rows.select("row", "digest", F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("key"),
                        F.length("payload").alias("size"))
    # Written, so that the join below has plain exchanges on both sides, which Spark can split where a key is hot.
    firsts = written(named.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first")), "warc-firsts")
    decided = named.where(F.col("size") >= least_bytes).join(firsts, "digest").where("first.row <> row").select(
        "row", record_name(F.col("first.id"), F.col("first.row")).alias("first"))
    return rows.join(bounded_broadcast(written(decided, "warc-revisits")), "row", "left")


def record_name(key: Column, row: Column) -> Column:
    """A record id that is unique per row and carries the caller's id."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archives(planned: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzipped WARC 1.1 files under ``path`` from what :func:`plan_records` returns."""
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}").cast("binary")
    name = record_name(F.col("id"), F.col("row"))
    blocks = planned.select(
        name.alias("name"), "url", "digest", "first",
        F.when(F.col("first").isNull(), F.concat(head, chunked(F.col("payload"), chunk_bytes)))
        .otherwise(F.lit(f"HTTP/1.1 200 OK{CRLF}{CRLF}").cast("binary")).alias("block"))
    total = F.length("block").cast("long")
    last = F.floor((F.length("block") - 1) / segment_bytes).cast("int")
    parts = blocks.select("name", "url", "digest", "first", total.alias("total"), last.alias("last"), "block",
                          F.explode(F.sequence(F.lit(0), last)).alias("part"))
    parts = parts.withColumn("piece", F.substring("block", F.col("part") * segment_bytes + 1, F.lit(segment_bytes)))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value.cast("string"), F.lit(CRLF))
    only = lambda test, value: F.when(test, value).otherwise("")
    follows, split, again = F.col("part") > 0, F.col("last") > 0, F.col("first").isNotNull()
    # Control characters, line ends above all, cannot stand in a header line.
    uri = F.expr(
        r"if(url rlike '[\\x00-\\x1f\\x7f]', array_join(transform(split(url, ''), c -> if(ascii(c) < 32 or ascii(c) = 127, "
        "concat('%', lpad(hex(ascii(c)), 2, '0')), c)), ''), url)")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(follows, "continuation").when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(follows, F.concat(F.expr("substring(name, 1, length(name) - 1)"), F.lit(":part"), F.col("part").cast("string"), F.lit(">"))).otherwise(F.col("name"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        only(again, F.concat(line("WARC-Refers-To", F.col("first")),
                             line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        only(split, line("WARC-Segment-Number", F.col("part") + 1)),
        only(follows, line("WARC-Segment-Origin-ID", F.col("name"))),
        only(split & (F.col("part") == F.col("last")), line("WARC-Segment-Total-Length", F.col("total"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.length("piece")), F.lit(CRLF))
    # The writer ends each value with the second of the two line ends that close a record.
    parts.select(F.concat(header, F.col("piece").cast("string"), F.lit(CRLF)).alias("value")).write.option(
        "lineSep", CRLF).option("maxRecordsPerFile", records_per_file).text(path, compression="gzip")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files, gzipped or not, under ``path``.  A file that breaks off or holds no record head gives what
    stands before the fault and one row with ``error``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_parse_files, RECORD_SCHEMA)


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = bytes(content)
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            yield pd.DataFrame(list(parse_records(path, data)), columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])


_BREAK, _LINE = re.compile(rb"\r?\n\r?\n"), re.compile(rb"\r?\n")


def parse_records(path: str, data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = _BREAK.search(data, at)
        if not data.startswith(b"WARC/", at) or not end:
            yield (path, *[None] * 9, f"no record head at byte {at}")
            return
        fields = {}
        for line in _LINE.split(data[at:end.start()])[1:]:  # no other character ends a line
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip(" \t").lower()] = value.strip(" \t")
        size = fields.get("content-length", "")
        if not size.isdigit() or end.end() + int(size) > len(data):
            yield (path, *[None] * 9, f"the record at byte {at} breaks off")
            return
        at = end.end() + int(size)
        number = lambda key: int(fields[key]) if fields.get(key, "").isdigit() else None
        yield (path, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
               number("warc-segment-number"), fields.get("warc-segment-origin-id"), number("warc-segment-total-length"),
               fields.get("warc-refers-to"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
               data[end.end():at], None)
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1


def reassembled(records: DataFrame) -> DataFrame:
    """One row per record that is no continuation, its block made whole.

    ``error`` tells of missing or repeated segments and of a total length that does not fit; parts without
    their origin come as a row of the origin's id.  One record's segments meet in one row, as the
    record does; nothing else is gathered.
    """
    whole = records.where("segment is null and origin is null").select(
        "record_type", "record_id", "uri", "refers_to", "payload_digest", "block", "error")
    parts = records.where("segment is not null or origin is not null")
    piece = F.struct("segment", "block")
    groups = parts.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("total_length").alias("total"),
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("record_type", "uri", "refers_to", "payload_digest")])
    numbers = F.transform("pieces", lambda p: p["segment"])
    block = F.aggregate("pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["block"]))
    joined = groups.select(
        "record_type", "record_id", "uri", "refers_to", "payload_digest", block.alias("block"),
        F.when(numbers != F.sequence(F.lit(1), F.size("pieces")), F.lit("segments are missing or repeated"))
        .when(F.col("total").isNull(), F.lit("no last segment"))
        .when(F.length(block) != F.col("total"), F.lit("the total length does not fit")).alias("error"))
    return whole.unionByName(joined)


def payloads(records: DataFrame) -> DataFrame:
    """Adds ``payload``: the block without its HTTP head, chunks decoded; null with ``error`` if that fails."""
    fields = records.drop("block").columns

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [http_payload(b, e) for b, e in zip(batch["block"], batch["error"], strict=True)]
            yield batch[fields].assign(payload=[p for p, _ in pairs], error=[e for _, e in pairs])

    return records.mapInPandas(decode, records.drop("block").schema.simpleString()[7:-1].replace(":", " ") + ", payload binary")


def http_payload(block: bytes | None, error: str | None) -> tuple[bytes | None, str | None]:
    if error or block is None:
        return None, error or "no block"
    head, gap, body = bytes(block).partition(b"\r\n\r\n")
    if not gap:
        return None, "no end of the HTTP head"
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body, None
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None, "a chunk has no size"
        n = int(size, 16)
        if n == 0:
            return b"".join(out), None
        out.append(body[end + 2:end + 2 + n])
        if len(out[-1]) < n or body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None, "a chunk breaks off"
        at = end + 4 + n


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the pages as WARC records, read the archives back and describe each record by what was read.

    One row per page: ``id_col``, payload_bytes, payload_digest, record_type, refers_to.  Null payloads are
    empty ones.  An empty table writes no record.  Other columns are not read.  Payloads of any length are written in
    segments and read back whole; control characters in urls are percent-encoded.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "archives")
    write_archives(plan_records(pages, id_col, url_col, payload_col, least_bytes), path, segment_bytes, chunk_bytes)
    read = written(
        payloads(reassembled(read_records(spark, path))).select(
            "record_type", "record_id", "refers_to", "payload_digest", F.length("payload").cast("long").alias("size"),
            base32_sha1(F.col("payload")).alias("digest"), "error"), "warc-read")
    bad = read.where("error is not null or (record_type = 'response' and digest <> payload_digest)").select("record_id", "error").first()
    if bad:
        raise ValueError(f"record {bad['record_id']}: {bad['error'] or 'its payload does not fit its digest'}")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]*):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    sizes = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("size").alias("full"))
    return read.join(sizes, "refers_to", "left").select(
        number("record_id").alias(id_col), F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("size")).alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to").alias("refers_to"))
