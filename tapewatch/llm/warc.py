"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left.

Every record is a gzip member of its own. Members are written by Spark's text writer, so that its commit protocol
covers the archives: the last byte of a member (the top byte of its length, zero below 16 MiB) is the line separator;
a longer member is followed by one zero byte of padding, which readers skip. An archive ends with the member that
brings it to FILE_BYTES. The reader inflates a member in pieces and looks for each next magic or version line once, so
that its time follows the archive's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import scratch, write_files, written

READ = (
    "path string, offset long, length long, kind string, problem string, record_type string, record_id string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"
)
#: An archive ends with the record that brings it to so many bytes; a member is inflated so many bytes at a time.
FILE_BYTES, PIECE = 128 << 20, 1 << 16
#: Bytes in which the header of an uncompressed record ends.
MOST_HEADER = 1 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_SPACE = 0x7461706577 << 88


def record_urn(page_id: int) -> str:
    """A version-8 UUID that carries the page id."""
    n = page_id & (1 << 64) - 1
    return uuid.UUID(int=_SPACE | 8 << 76 | (n >> 60) << 64 | 2 << 62 | n & (1 << 60) - 1).urn


def page_of(urn: str | None) -> int | None:
    try:
        n = uuid.UUID((urn or "").strip("<>")).int
    except ValueError:
        return None
    if n >> 88 != _SPACE >> 88:
        return None
    page = (n >> 64 & 0xF) << 60 | n & (1 << 60) - 1
    return page - (1 << 64) if page >> 63 else page


def _no_id(row: tuple) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, repr(row)).urn


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the HTTP header, which tells the length of the payload that it leaves out."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    urn = _no_id((url, digest)) if page_id is None else record_urn(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_32(block)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero, or that is followed by a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + b"\0"


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html", level: int = 4, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record for each page (null body: empty payload).

    Of pages with equal payloads of at least `min_revisit_bytes`, the one with the largest id is the response and
    the others revisit it. Rows that repeat this largest id, and rows without an id, are responses.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = src.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.count("page_id").alias("n"), F.max("page_id").alias("winner"))
    winners = written(groups.where("n > 1").select("sha", "winner"), "warc-winners")
    marked = src.join(winners, "sha", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("winner"), F.col("winner")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            rows = []
            for page, url, data, ref in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = data.as_py()
                out = member(record(page, url, raw, sha1_32(raw), ref, date), level)[:-1]
                rows.append((total // file_bytes, 0, out))
                total += len(out) + 1
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["seg", "k", "data"])

    write_files(marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "seg int, k long, data binary"), path)


def parse(data: bytes) -> dict:
    """The fields of one plain record; ValueError with the reason where a check fails."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        raise ValueError("no version line or header end")
    head: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("missing or malformed Content-Length")
    size, at = int(head["content-length"]), end + 4
    if data[at + size : at + size + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where Content-Length says")
    block = data[at : at + size]
    if (d := head.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != sha1_32(block):
        raise ValueError("block digest differs")
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, length = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", http)
        length = int(said[1]) if kind == "revisit" and said else len(payload)
    if kind == "response" and digest and digest != sha1_32(payload):
        raise ValueError("payload digest differs")
    rid, ref = head.get("warc-record-id"), head.get("warc-refers-to")
    return {"record_type": kind, "record_id": rid, "page_id": page_of(rid), "target_uri": head.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": length, "refers_to_id": ref, "refers_to": page_of(ref), "payload": payload if kind != "revisit" else None, "size": at + size + 4}


def _at(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a byte, and the byte after it."""
    if data.startswith(MAGIC, at):
        z, parts, end, view = zlib.decompressobj(31), [], at, memoryview(data)
        try:
            while not z.eof and end < len(data):
                parts.append(z.decompress(view[end : end + PIECE]))
                end = min(end + PIECE, len(data))
        except zlib.error as e:
            raise ValueError(f"gzip member: {e}") from None
        if not z.eof:
            raise ValueError("gzip member is cut short")
        plain = b"".join(parts)
        fields = parse(plain)
        if fields["size"] != len(plain):
            raise ValueError("more bytes in the member than the record has")
        return fields, end - len(z.unused_data)
    if data.startswith(VERSION, at):
        stop = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
        said = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})\s*\r\n", data[at : stop + 2]) if stop >= 0 else None
        if not said:
            raise ValueError("no header end or Content-Length")
        end = stop + 8 + int(said[1])
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError("block does not end where Content-Length says")
        return parse(data[at:end]), end
    raise ValueError("neither a gzip member nor a version line")


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive and the quarantined gaps between them, in order.

    Where a check fails, the next gzip magic or version line is looked for and tried, until a record passes all
    checks; the bytes between are one gap, with the first check that failed.
    """
    at, bad, why = 0, -1, ""
    ahead = {MAGIC: -1, VERSION: -1}  # where each stands next; looked for again only once it lies behind
    while at < len(data):
        if data[at] == 0 and bad < 0:  # padding
            at += 1
            continue
        try:
            fields, end = _at(data, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            for mark, k in ahead.items():
                if k <= at:
                    k = data.find(mark, at + 1)
                    ahead[mark] = k if k >= 0 else len(data)
            at = min(ahead.values())
            continue
        if bad >= 0:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "problem": why}
            bad = -1
        yield {"kind": "record", "offset": at, "length": end - at, **fields}
        at = end
    if bad >= 0:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "problem": why}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record (kind 'record') and each quarantined gap of bytes (kind 'gap') of all archives below path."""
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[dict] = []
                for r in salvage(data.as_buffer().to_pybytes()):
                    if not with_payload:
                        r.pop("payload", None)
                    rows.append({"path": name, **r})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages into archives in the shared folder and reads them back, without payloads."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return read_archives(pages.sparkSession, path, with_payload=False)
