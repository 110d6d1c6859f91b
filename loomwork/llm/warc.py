"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing uses Spark's text sink, which copies a string column's bytes as they are: records are gzip members of their
own, and each row is a file of members, of `file_bytes` at most or of one record. Of the records with equal
payloads of at least `least` bytes, the one with the smallest page_id is a response and the others refer to
it: only digests that repeat are joined, each `SALTS` times, so that a page with very many copies is in no one task.

Reading takes whole files by Spark's binary source, so a file has to fit into a task and into the source's 2 GB; the
writer bounds the bytes of a file. Each record must pass its checks (gzip's checksum, the version line, Content-Length, the
payload's digest). Where one fails, the reader looks for the next member or version line that passes all of
them, and the bytes between are a row of kind "gap" with the reason.

Defined results: a null html is an empty payload; a null url leaves the target out; a null page_id is written
as an id of its own and read as null, and with equal payloads it refers to the smallest page_id that is not null.
Repeated rows with the smallest page_id are all responses. An empty table gives an empty archive. `read` returns
gaps as rows; `report`, whose archives are its own, fails if there is one. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import shared_dir, utf8

URN, NONE = "urn:loomwork:page:", "urn:loomwork:none"
DATE = "2000-01-01T00:00:00Z"
#: Parts of a repeated digest.
SALTS = 16
REQUIRED = frozenset(("warc-type", "warc-date", "warc-record-id", "content-length"))
START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.[0-9]")


def typed(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to."""
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    shared = (
        rows.where(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("shared"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("shared", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(shared, (F.col("digest") == F.col("shared")) & (salt == F.col("salt")), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <{NONE if page_id is None else URN + quote(page_id, safe='')}>",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []),
        *([f"WARC-Refers-To: <{URN}{quote(refers_to, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, path: str, least: int = 100, file_bytes: int = 1 << 25) -> None:
    """Writes archives below path, each of file_bytes at most or of one record."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = member(record(*row))
                if held and size + len(data) > file_bytes:
                    yield file(held)
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield file(held)

    def file(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    rows = typed(pages, least).select(
        F.col("page_id").cast("string"), "url", "payload", "digest", "record_type", F.col("refers_to").cast("string")
    )
    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # the zero byte that ends a row is padding, which gzip readers skip
    out.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


class Damaged(Exception):
    """A record that fails a check; the message is the reason."""


def parse(data: bytes, start: int, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the plain record at start, or Damaged. whole: it must end the data."""
    if not re.match(rb"WARC/[01]\.[0-9]\r\n", data[start : start + 12]):
        raise Damaged("version line")
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[start:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line")
        key = name.strip().lower().decode("latin-1")
        if key in headers:  # the end of one record's header may be missing
            raise Damaged("header repeated")
        headers[key] = value.strip().decode("utf-8", "replace")
    if not REQUIRED <= headers.keys():
        raise Damaged("header missing")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("content length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n" or whole and end + 4 != len(data):
        raise Damaged("block end")
    http, gap, payload = data[stop + 4 : end].partition(b"\r\n\r\n")
    if headers.get("content-type", "").startswith("application/http"):
        if not gap or not http.startswith(b"HTTP/"):
            raise Damaged("http header")
        if m := re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http):
            headers["http-content-length"] = m[1].decode()
    else:
        payload = data[stop + 4 : end]
    kind, _, value = headers.get("warc-payload-digest", "").partition(":")
    if headers.get("warc-type") == "response" and kind == "sha256" and value != hashlib.sha256(payload).hexdigest():
        raise Damaged("payload digest")
    return headers, payload, end + 4


def attempt(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """The record at start, in a gzip member or plain."""
    if data[start : start + 2] != b"\x1f\x8b":
        return parse(data, start, False)
    unpack = zlib.decompressobj(31)
    try:
        plain = unpack.decompress(data[start:] if start else data)
    except zlib.error as e:
        raise Damaged("gzip data") from e
    if not unpack.eof:
        raise Damaged("gzip data ends early")
    headers, payload, _ = parse(plain, 0, True)
    return headers, payload, len(data) - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """(start, end, reason, headers, payload) of the records, reason None, and of the gaps, payload None."""
    at, bad, why = 0, None, ""
    view = data
    while at < len(data):
        while bad is None and at < len(data) and data[at] in b"\x00\r\n":
            at += 1
        if at == len(data):
            break
        try:
            # one member is seldom larger than a few MB: a bounded view avoids copying the rest each time
            for room in (1 << 20, 1 << 25, len(data)):
                view = data[at : at + room]
                try:
                    headers, payload, size = attempt(view, 0)
                    break
                except Damaged:
                    if at + room >= len(data):
                        raise
        except Damaged as e:
            if bad is None:
                bad, why = at, str(e)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield bad, at, why, None, None
            bad = None
        yield at, at + size, None, headers, payload
        at += size
    if bad is not None:
        yield bad, len(data), why, None, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of records and gaps: path, start, stop, kind, reason, headers, payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for start, end, reason, headers, payload in salvage(data.as_py()):
                    rows.append((name, start, end, "gap" if reason else "record", reason, list((headers or {}).items()), payload))
                    size += len(payload or b"")
                    if size > 1 << 24:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["path", "start", "stop", "kind", "reason", "headers", "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, "path string, start long, stop long, kind string, reason string, headers map<string,string>, payload binary")


def report(pages: DataFrame) -> DataFrame:
    """The rows of query op5: archives are written to the shared folder and read back."""
    path = shared_dir(pages.sparkSession)
    write(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()

    def urn(header: str):
        return F.expr(f"url_decode(nullif(regexp_extract(headers['{header}'], '^<{URN}(.*)>$', 1), ''))")

    revisit = F.col("headers")["warc-type"] == "revisit"
    gap = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", F.lit("at"), "start", F.lit("to"), "stop", F.lit(":"), "reason"))
    return (
        read(pages.sparkSession, path)
        .where(F.when(F.col("kind") == "gap", gap.cast("boolean")).otherwise(True))
        .select(
            urn("warc-record-id").cast(kind).alias("page_id"),
            F.when(revisit, F.col("headers")["http-content-length"].cast("long")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
            F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
            F.col("headers")["warc-type"].alias("record_type"),
            urn("warc-refers-to").cast(kind).alias("refers_to"),
        )
    )
