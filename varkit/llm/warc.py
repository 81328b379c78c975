"""Web archives: WARC records with segments and revisits, written and read back.

Writing: each page is an HTTP response in chunked transfer framing.  Of records with the same
payload the one with the smallest id is a ``response``; the others are ``revisit`` records that
name it.  A block longer than ``segment_bytes`` is split into segments: the first record has
``WARC-Segment-Number: 1``, the rest are ``continuation`` records that name it by
``WARC-Segment-Origin-ID``, the last of them with ``WARC-Segment-Total-Length``.  Files are
gzip-compressed and written through Spark's own text writer (payloads are UTF-8, so a record is
a string, and the two line breaks after a record are the line separator), so they land on
whatever store Spark writes to.

Reading: files are read whole (``records_per_file`` and ``segment_bytes`` bound their size) and
parsed by ``Content-Length``, never by separators.  Continuations may lie in any file: segments
are grouped by origin id, ordered by number and put together; the total length is verified, then the chunked
framing is decoded and the payload digest checked.  A record that fails a check raises.

Edge cases: a NULL html is an empty payload; a NULL url is written as ``about:blank`` and read
back as given in the page table by the caller; NULL ids never become the response of others with
an id, and are ordered last.  Rows equal in id and payload are all responses if their id is the
smallest.  An empty table writes an archive without records, which reads back as empty.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varkit.llm.common import stored


CRLF = "\r\n"
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 4000
DATE = "2020-01-01T00:00:00Z"

RECORD_SCHEMA = ("record_id string, record_type string, page_id long, digest string, refers_to long, payload_bytes long, "
                 "origin_id string, segment_no int, total_length long, block binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing.  Chunks end between characters, so that framed text stays text."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2:line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its length says")
        at = line + 4 + size


def _pieces(block: bytes, size: int) -> list[bytes]:
    """``block`` in pieces of at most ``size`` bytes that end between characters."""
    out, at = [], 0
    while at < len(block) or not out:
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return out


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> str:
    head = [f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"] + [f"{k}: {v}{CRLF}" for k, v in fields if v is not None]
    return "".join([*head, f"Content-Length: {len(block)}{CRLF}{CRLF}", block.decode()])


def page_records(page_id, url, html: str, digest: str, refers_to, key: str, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """The records of one page.  ``key`` is unique for the row; record ids derive from it."""
    record = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{n}')}>"
    payload = html.encode()
    fields = [("WARC-Record-ID", record(1)), ("WARC-Date", DATE),
              ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload))]
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}".encode()
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
        return [_record("revisit", [*fields, ("Content-Type", "application/http; msgtype=response")], head)]
    block = head + chunked(payload)
    parts = _pieces(block, segment_bytes)
    http = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        return [_record("response", [*fields, http], block)]
    out = [_record("response", [*fields, http, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(_record("continuation", [
            ("WARC-Record-ID", record(n)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", record(1)), ("WARC-Segment-Number", n),
            ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record (and its continuations) per row; revisits only for payloads of at least
    ``min_bytes`` bytes.

    Originals are found by an aggregate over the digest, which a hot payload enters as one row per
    task; only digests held twice or more are joined back, and adaptive execution splits a hot one.
    """
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    firsts = (rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("sha").alias("_sha"), "first"))
    rows = rows.join(firsts, rows["sha"] == firsts["_sha"], "left")

    def build(batches):
        for b in batches:
            out = []
            for pid, url, text, first in zip(*[b.column(i).to_pylist() for i in range(4)]):
                refers = first if first is not None and first != pid else None
                # ids are drawn at random: a record's segments are written by one task attempt
                out += page_records(pid, url, text, sha1_base32(text.encode()), refers, uuid.uuid4().hex, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (rows.select("id", "url", "html", "first").mapInArrow(build, "value string").write
     .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes):
    """(header fields, block) of each record in the bytes of an archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in data[at:stop].decode().split(CRLF)[1:])
        size = int(head["Content-Length"])
        block = data[stop + 4:stop + 4 + size]
        if len(block) != size:
            raise ValueError("a record is shorter than its length says")
        yield head, block
        at = stop + 4 + size + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, segments still apart.  Segment blocks are kept,
    other blocks are decoded and checked here, so that only segments are shuffled."""
    def rows(batches):
        for b in batches:
            for content in b["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                out = []
                for head, block in parse(data):
                    number = lambda k: int(head[k]) if k in head else None  # noqa: E731,B023
                    kind, seg = head["WARC-Type"], number("WARC-Segment-Number")
                    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    size = number("X-Payload-Length")
                    if kind == "response" and seg is None:
                        size = len(checked_payload(block, digest))
                        block = None
                    elif kind == "revisit":
                        block = None
                    out.append((head["WARC-Record-ID"], kind, number("X-Page-ID"), digest, number("X-Refers-To-Page-ID"), size,
                                head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), seg, number("WARC-Segment-Total-Length"), block))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(rows, RECORD_SCHEMA)


def checked_payload(block: bytes, digest: str | None) -> bytes:
    head, _, body = bytes(block).partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest is not None and sha1_base32(payload) != digest:
        raise ValueError("payload digest doesn't match")
    return payload


def reassembled(records: DataFrame) -> DataFrame:
    """Responses, whole: record_id, page_id, digest, payload.  A group is the segments of one
    record, which is one page's size, however many records there are."""
    def join(key, pdf):
        pdf = pdf.sort_values("segment_no")
        numbers, total = list(pdf["segment_no"]), pdf["total_length"].dropna()
        block = b"".join(bytes(x) for x in pdf["block"])
        if numbers != list(range(1, len(numbers) + 1)) or len(total) != 1 or int(total.iloc[0]) != len(block):
            raise ValueError(f"segments of {key[0]} don't make up the record")
        first = pdf.iloc[0]
        payload = checked_payload(block, first["digest"])
        return pd.DataFrame([(first["record_id"], first["page_id"], first["digest"], payload)], columns=["record_id", "page_id", "digest", "payload"])

    # only a record's first segment names the page; pandas would turn a column of one number and NULLs into doubles
    segments = records.where("segment_no IS NOT NULL").withColumn("page_id", F.col("page_id").cast("string"))
    whole = segments.groupBy("origin_id").applyInPandas(join, "record_id string, page_id string, digest string, payload binary")
    return whole.withColumn("page_id", F.col("page_id").cast("long"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.  A
    revisit's figures are those in its header, which name the full payload."""
    records = stored(read_records(spark, path), "warc-records")
    single = records.where("segment_no IS NULL").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    whole = reassembled(records).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return single.unionByName(whole)
