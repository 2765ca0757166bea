"""Legacy ARC archives: their records, and the WARC records that say the same."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import only, sliced
from shoal.session import materialize

# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes below which a record is never a revisit.
LEAST_BYTES = 100
#: Raw bytes of a segment: one cell of an archive table, a whole number of records.
SEGMENT_BYTES = 1 << 20
RECORD = ("page_id long, url string, ip string, date string, content_type string, record_id string, kind string, "
          "head binary, payload binary, payload_bytes long, payload_digest string")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str  # 14 digits
    content_type: str
    body: bytes


def _field(text: str | None) -> str:
    """A header field may hold no white space or control character; they are percent-encoded. Null is ``-``."""
    if text is None:
        return "-"
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text) or "-"


def arc_version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 shoal\n{ARC_FIELDS[version]}\n\n".encode()
    tail = f"200 - - 0 segment {len(body)}" if version == 2 else f"{len(body)}"
    return f"filedesc://segment 0.0.0.0 {date} text/plain {tail}\n".encode() + body + b"\n"


def arc_record(version: int, record: ArcRecord, offset: int) -> bytes:
    size = len(record.body)
    tail = f"200 - - {offset} segment {size}" if version == 2 else f"{size}"
    return f"{_field(record.url)} {record.ip} {record.date} {record.content_type} {tail}\n".encode() + record.body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block. The block's version says how many fields a header line has; the last one is the
    length of the body. A line that does not fit, or a body that is cut off, raises ValueError."""
    version, at = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":  # the separator between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        first = not version
        if first and not line.startswith("filedesc://"):
            raise ValueError(f"no version block: {line[:80]!r}")
        fields = line.rsplit(" ", 4 if first else len(ARC_FIELDS[version].split()) - 1)
        if first and end >= 0:
            version = int(data[end + 1:data.find(b" ", end + 1)] or 0)
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = line.rsplit(" ", len(ARC_FIELDS[version].split()) - 1)
        if end < 0 or len(fields) != len(ARC_FIELDS[version].split()) or not fields[-1].isdigit():
            raise ValueError(f"bad ARC header line: {line[:80]!r}")
        stop = end + 1 + int(fields[-1])
        if stop > len(data):
            raise ValueError(f"truncated ARC record: {line[:80]!r}")
        if not first:
            yield ArcRecord(*fields[:4], data[end + 1:stop])
        at = stop


def _head_end(body: bytes) -> int:
    """Where the payload of an HTTP response begins: after the first empty line, whether lines end with CRLF or a bare LF;
    without one all of it is head."""
    found = re.search(rb"\n\r?\n", body)
    return found.end() if found else len(body)


def _http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.encode():
            return value.strip().decode()
    return None


def equivalent(record: ArcRecord) -> dict:
    """What the WARC record of an ARC record says: an id made from its content, ISO time, type, head and payload."""
    head, payload = b"", record.body
    kind = "resource"
    if record.body.startswith(b"HTTP/"):
        kind, cut = "response", _head_end(record.body)
        head, payload = record.body[:cut], record.body[cut:]
    digest = hashlib.sha256(payload).hexdigest()
    d = record.date.ljust(14, "0")
    page = _http_field(head, "x-page-id")
    name = f"{record.url} {record.date} {hashlib.sha256(head).hexdigest()} {digest}"
    return {"page_id": None if page is None else int(page), "url": record.url, "ip": record.ip,
            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "content_type": record.content_type,
            "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", "kind": kind, "head": head, "payload": payload,
            "payload_bytes": len(payload), "payload_digest": digest}


def warc_record(r: dict) -> bytes:
    """One gzip member. A revisit keeps the HTTP head only and names the record that has the payload."""
    revisit = r["kind"] == "revisit"
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {r['kind']}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}",
             f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{r['refers_record']}>", f"X-Refers-To-Page-Id: {r['refers_to']}"]
    http = bool(r["head"])
    lines += [f"Content-Type: {'application/http;msgtype=response' if http else r['content_type']}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def unzipped(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of a segment, one at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(data):
                raise ValueError("truncated gzip member")
            piece = view[at:at + step]
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(parts)


def parse_warc(member: bytes) -> dict:
    """Fields and block of a record; a wrong length or digest raises ValueError."""
    cut = member.find(b"\r\n\r\n")
    version, *lines = member[:cut].decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = member[cut + 4:-4]
    if not version.startswith("WARC/") or len(block) != int(fields["content-length"]):
        raise ValueError("bad WARC record")
    if hashlib.sha256(block).hexdigest() != fields["warc-block-digest"].removeprefix("sha256:"):
        raise ValueError("block digest differs")
    return fields | {"block": block}


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 date: str = "20240101000000") -> DataFrame:
    """``content``: ARC segments of about a megabyte, versions 1 and 2 in turn, one HTTP record per page (null html: no
    payload). The page id travels as a field of the HTTP head; a null id is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in sliced(batches, "html", SEGMENT_BYTES):
            out = [arc_version_block(version, date)]
            size = len(out[0])
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                payload = (html or "").encode()
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                out.append(arc_record(version, ArcRecord(url, "0.0.0.0", date, "text/html", head.encode() + payload), size))
                size += len(out[-1])
            yield pa.RecordBatch.from_pydict({"content": pa.array([b"".join(out)], pa.binary())})
            version = 3 - version

    return only(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, "content binary")


_RECORD = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]])
                     for x in RECORD.split(", ")])


def arc_records(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of ARC segments as WARC says them (see ``equivalent``); null segments have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"].to_pylist():
                yield pa.RecordBatch.from_pylist([equivalent(x) for x in parse_arc(data or b"")], _RECORD)

    return only(arcs, content=content_col).mapInArrow(run, RECORD)


def to_warc(records: DataFrame) -> DataFrame:
    """``content``: WARC segments of gzip members. Of responses with equal payloads of at least ``LEAST_BYTES`` bytes that
    with the smallest page id (all rows that have it) is kept as it is, the others become revisits of it."""
    firsts = materialize(
        records.where((F.col("payload_bytes") >= LEAST_BYTES) & (F.col("kind") == "response"))
        .groupBy("payload_digest").agg(
            F.expr("min(CASE WHEN page_id IS NOT NULL THEN struct(page_id, record_id) END)").alias("first"),
            F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
        .select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_record")),
        "firsts")
    typed = records.join(firsts, "payload_digest", "left").withColumn("kind", F.expr(
        "CASE WHEN kind = 'response' AND refers_to IS NOT NULL AND (page_id IS NULL OR page_id > refers_to) "
        f"AND payload_bytes >= {LEAST_BYTES} THEN 'revisit' ELSE kind END"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "payload", SEGMENT_BYTES):
            members = b"".join(map(warc_record, batch.to_pylist()))
            yield pa.RecordBatch.from_pydict({"content": pa.array([members], pa.binary())})

    return typed.mapInArrow(run, "content binary")


def read_warc(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """``page_id, url, record_id, record_type, payload_bytes, payload_digest, refers_to, payload`` of WARC segments.

    Length and digest of a revisit are those of the full payload (its HTTP head and digest field have them); its own
    payload is null. Lengths and digests are checked; what does not fit raises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"].to_pylist():
                rows = []
                for r in map(parse_warc, unzipped(data or b"")):
                    revisit, block = r["warc-type"] == "revisit", r["block"]
                    cut = _head_end(block) if r["content-type"].startswith("application/http") else 0
                    page, digest = _http_field(block[:cut], "x-page-id"), r["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(block[cut:]).hexdigest() != digest:
                        raise ValueError("payload digest differs")
                    refers = r.get("x-refers-to-page-id")
                    rows.append({
                        "page_id": None if page is None else int(page), "url": r["warc-target-uri"],
                        "record_id": r["warc-record-id"].strip("<>"), "record_type": r["warc-type"],
                        "payload_bytes": int(_http_field(block[:cut], "content-length")) if revisit else len(block) - cut,
                        "payload_digest": digest, "refers_to": None if refers is None else int(refers),
                        "payload": None if revisit else block[cut:]})
                yield pa.RecordBatch.from_pylist(rows, _READ)

    return only(archives, content=content_col).mapInArrow(run, READ)


READ = ("page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary")
_READ = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]])
                   for x in READ.split(", ")])
