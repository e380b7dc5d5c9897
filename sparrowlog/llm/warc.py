"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is a row of headers and block.  Each yields a ``metadata``
record, with the source's HTTP headers and digests as warc-fields, and a
``conversion`` record with the plain text of its payload.  Both name the
response in WARC-Refers-To, have its URI and date, and digests of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, tidy

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, header string, block string"

_DROPPED = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)|<head\b[^>]*>.*?(?=<body\b|</head\s*>|$)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|aside|nav|header|footer|main|form|blockquote|pre|figure|figcaption|title|address)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>?")
_SPACE = re.compile(r"[ \t\r\f\v ]+")


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(markup: str) -> str:
    """The text of a page, a line for each block: without comments, scripts, styles, head and tags, with references decoded."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub("", markup)))
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def split_block(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in lower case; a repeated one joined by a comma) and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", {}, block
    lines = head.decode("latin-1").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    return lines[0], fields, payload


def _id(*parts: str) -> str:
    """The same name for the same parts, so that a task that runs again makes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _record(kind: str, rid: str, refers_to: str, uri: str, date: str, content_type: str, payload_digest: str, block: str) -> tuple:
    data = block.encode()
    digest = sha1_label(data)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest), ("WARC-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    header = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return rid, kind, refers_to, uri, date, content_type, digest, payload_digest, len(data), header, block


def derive(record_id: str, uri: str, date: str, block: bytes) -> list[tuple]:
    status, fields, payload = split_block(block)
    source_digest = sha1_label(payload)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", fields.get("content-type", ""))
    try:
        markup = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        markup = payload.decode("utf-8", "replace")
    text = plain_text(markup)
    lines = [("source-record", record_id), ("source-payload-digest", source_digest), ("source-block-digest", sha1_label(block)), ("source-payload-length", str(len(payload))), ("http-status", status), *((f"http-header-{k}", v) for k, v in sorted(fields.items())), ("text-length", str(len(text)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return [
        _record("metadata", _id("metadata", record_id), record_id, uri, date, "application/warc-fields", "", meta),
        _record("conversion", _id("conversion", record_id), record_id, uri, date, "text/plain; charset=utf-8", source_digest, text),
    ]


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Response records (key, record_id, target_uri, warc_date, block) of stored pages, with the HTTP head of a plain 200 answer.

    The date follows from the key, as pages have none; a null body is empty, a
    null URL is an empty URI, a null key counts as -1.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(-1))
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]+", " ")
    data = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    digest = F.md5(F.concat(k.cast("string").cast("binary"), F.lit("\0").cast("binary"), uri.cast("binary"), F.lit("\0").cast("binary"), data))
    rid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(k, F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(data).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(key).alias("key"), rid.alias("record_id"), uri.alias("target_uri"), date.alias("warc_date"), F.concat(head.cast("binary"), data).alias("block"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response (key, record_id, target_uri, warc_date, block): its metadata and its conversion record.

    ``header`` and ``block`` are the record's text; a null block is empty.
    Repeated responses repeat their derivatives under the same names.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                keys, rows = [], []
                for k, rid, uri, date, block in zip(*(c.to_pylist() for c in part.columns)):
                    for r in derive(rid or "", uri or "", date or "", block or b""):
                        keys.append(k)
                        rows.append(r)
                columns = list(zip(*rows)) or [[]] * 11
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64() if i == 8 else pa.string()) for i, c in enumerate(columns))], names)

    bound_batches(records.sparkSession)
    names = ["key", *(x.split()[0] for x in RECORD.split(", "))]
    return records.select(F.col("key").cast("long"), "record_id", "target_uri", "warc_date", "block").mapInArrow(tidy(run), f"key long, {RECORD}")


def record_text(header: str = "header", block: str = "block") -> Column:
    """A record as it stands in a file."""
    return F.concat(F.col(header), F.lit("\r\n"), F.col(block), F.lit("\r\n\r\n"))


def write_warc(records: DataFrame, path: str) -> None:
    """Files of records, gzipped, each task its own; the separator of lines is the last character of a record."""
    whole = record_text()
    records.select(F.substring(whole, 1, F.char_length(whole) - 1).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record in the bytes of a file, by the lengths that the records state."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        fields = {k: v for k, _, v in (line.partition(": ") for line in lines)}
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        out.append((fields, data[begin:at]))
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4
    return out


def read_warc(spark, path: str) -> DataFrame:
    """Records of files that write_warc made: record_id, warc_type, refers_to, target_uri, warc_date, content_type, block_digest, payload_digest, content_length, block.

    A file is read whole, so files should be of the usual size of an archive's.
    """
    names = ["WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Length"]
    kinds = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length string, block binary"

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                for lo in range(0, len(rows := parse_records(gzip.decompress(raw))), 512):
                    part = rows[lo : lo + 512]
                    columns = [pa.array([f.get(n, "") for f, _ in part], pa.string()) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([block for _, block in part], pa.binary())], [x.split()[0] for x in kinds.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(tidy(run), kinds).withColumn("content_length", F.col("content_length").cast("long"))
