"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A frame is: payload length (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4),
one zero byte. The payload is: flag (1, bit 0: the id is null), id (8), bytes for each token id (1), number of ids (4),
ids. All numbers are little-endian. Frames are written by Spark's text writer with the zero byte as line separator,
so that its commit protocol covers them. Files are in ascending id order, by part number, then segment number; a
segment ends with the frame that brings it to FILE_BYTES.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import scratch, write_files
from tapewatch.llm.tokens import encoder

HEAD, BODY = struct.Struct("<QI"), struct.Struct("<BqBI")
INDEX = "path string, part long, file long, record long, offset long, length long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"
#: A file ends with the record that brings it to so many bytes.
FILE_BYTES = 128 << 20
#: Files above this count are joined by key instead of being sent to each executor (about 200 bytes each).
FILES_SENT = 100_000


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits and shifted by a constant, so that a checksum of checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, itemsize: int) -> bytes:
    body = BODY.pack(doc_id is None, doc_id or 0, itemsize, len(ids) // itemsize) + ids
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body)) + b"\0"


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, frame length, id, ids) of each frame from `at`; raises ValueError where a checksum or length is wrong."""
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"frame at byte {at} is cut short")
        size, check = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"length at byte {at} fails its checksum")
        body = data[at + HEAD.size : at + HEAD.size + size]
        end = at + HEAD.size + size + 5
        if end > len(data) or struct.unpack_from("<I", data, end - 5)[0] != masked(body) or data[end - 1]:
            raise ValueError(f"record at byte {at} fails its checksum")
        null, doc, itemsize, n = BODY.unpack_from(body)
        yield at, end - at, None if null else doc, np.frombuffer(body, f"<u{itemsize}", n, BODY.size)
        at = end


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every whole text (null: empty), in ascending id order, null ids first.

    Rows with the same id stay together, in an order given by their text's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        total = k = 0
        for b in batches:
            texts = (t.as_py() for t in b.column(1))
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                data = frame(d, ids.tobytes() + tail, enc.dtype.itemsize)[:-1]
                rows.append((total // file_bytes, k, data))
                total, k = total + len(data) + 1, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["seg", "k", "data"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    ready = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    write_files(ready.mapInArrow(run, "seg int, k long, data binary"), path, ordered=True)


def index_records(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Reads the record files back, checks every frame and writes the offset index, one row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part, file = map(int, re.search(r"/seg=(\d+)/part-(\d+)-[^/]*$", name).group(2, 1))
                rows, start = [], 0
                for k, (at, length, doc, ids) in enumerate(frames(data.as_buffer().to_pybytes())):
                    rows.append((name, part, file, k, at, length, doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                kinds = [pa.string()] + [pa.int64()] * 9
                cols = list(zip(*rows, strict=True)) or [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    files.mapInArrow(run, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all records before this one, over all files in order."""
    from pyspark.sql import Window

    totals = index.groupBy("path", "part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    if index.select("path").distinct().count() <= FILES_SENT:
        base = F.broadcast(base)
    return index.join(base, "path").withColumn("start", F.col("base") + F.col("start_in_file"))


def read_at(spark: SparkSession, picks: DataFrame) -> DataFrame:
    """Shuffled reads: the ids of the index rows in `picks` (path, offset), each file opened once: (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, offsets in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = data.as_buffer().to_pybytes()
                got = [next(frames(raw, at)) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([g[2] for g in got], pa.int64()), pa.array([g[3].tolist() for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    folders = [r.path for r in picks.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    wanted = picks.groupBy("path").agg(F.collect_list("offset").alias("offsets"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders).select("path", "content")
    return files.join(wanted, "path").select("content", "offsets").mapInArrow(run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents into the shared folder and returns what is read back from the files, with `start`."""
    spark = docs.sparkSession
    path = scratch(spark, "records")
    write_records(docs, path, tokenizer, end_id, id_col, text_col)
    return starts(index_records(spark, path, scratch(spark, "records-index")))
