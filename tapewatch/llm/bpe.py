"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text above `chunk` characters is cut into chunks that overlap, which are pre-tokenised apart from each other. What the
pattern matches from a position on depends on the text behind that position only. So where the matches of a chunk and
those of the chunk before it end at the same place in their overlap, both go on alike: the texts are stitched there, and
each piece between two such places is encoded by itself. Chunks without a common place, such as those inside one very
long word, are joined and pre-tokenised again until every overlap has one. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapewatch.llm.common import written

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Characters behind a match that the pattern may have looked at; a match nearer to the end of a chunk is not settled.
LOOK = 4
#: Columns of the result.
OUT = ("row", "piece", "ids")
#: Bytes of ids after which a batch is handed on.
HAND_ON = 1 << 22


@cache
def encoding(path: str, pattern: str):
    """The encoding of a rank file; workers open it once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def splitter(pattern: str):
    """The pattern for Python, its character classes being those of the encoding library (they differ by Unicode version)."""
    import regex
    import tiktoken

    byte_ranks = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))

    @cache
    def members(name: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=byte_ranks, special_tokens={})
        points = np.array(sorted(set(map(ord, bytes(probe.encode_ordinary(every)).decode()))))
        runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
        return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)

    out, bracket, at = [], False, 0
    for m in regex.finditer(r"\\[pP]\{\w+\}|\\[sSdDwW]|\\.|\[|\]", pattern):
        out.append(pattern[at : m.start()])
        at, token = m.end(), m[0]
        if token in ("[", "]"):
            bracket = token == "["
        elif regex.fullmatch(r"\\[ps](\{\w+\})?", token):
            token = members(token) if bracket else f"[{members(token)}]"
        elif token == r"\S":
            token = f"[^{members(chr(92) + 's')}]"
        out.append(token)
    return regex.compile("".join([*out, pattern[at:]]))


def settled(text: str, pattern: str, final: bool) -> list[int]:
    """Where matches of the pattern end, from the start on; without those that the text behind a cut may change."""
    out = []
    for m in splitter(pattern).finditer(text):
        if not final and m.end() + LOOK > len(text):
            break
        out.append(m.end())
    return out


def clean(text: str, pattern: str, ends: list[int], least: int) -> list[int]:
    """Of the ends from `least` on, those at which the text may be cut: what stands before them is matched alike without the rest."""
    out = []
    for i in range(bisect_left(ends, least), len(ends)):
        j = max(0, i - LOOK)  # matches before that cannot see behind ends[i]
        if [m.end() for m in splitter(pattern).finditer(text, ends[j], ends[i])] == ends[j + 1 : i + 1]:
            out.append(ends[i])
    return out


def _chunked(src: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(kept, row, k, start, next, text): chunk k holds the text from start to `overlap` behind next (null at the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text")):
                one, text = b.slice(i, 1), text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    rows = pa.array([0] * len(some))
                    following = [s + chunk if s + chunk < max(1, len(text) - overlap) else None for s in some]
                    texts = [text[s : s + chunk + overlap] if n is not None else text[s:] for s, n in zip(some, following, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [one.column("kept").take(rows), one.column("row").take(rows), pa.array([s // chunk for s in some], pa.int64()),
                         pa.array(list(some), pa.int64()), pa.array(following, pa.int64()), pa.array(texts, pa.string())],
                        names=["kept", "row", "k", "start", "next", "text"],
                    )

    schema = StructType([src.schema["kept"], src.schema["row"]]).add("k", "long").add("start", "long").add("next", "long").add("text", "string")
    return src.mapInArrow(run, schema)


def _ends(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """(row, k, start, next, head, tail): where matches end in the overlap with the chunk before, and where the text may be cut in that behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for start, following, text in zip(b.column("start").to_pylist(), b.column("next").to_pylist(), b.column("text"), strict=True):
                ends = [0, *settled(text.as_py(), pattern, following is None)]
                head.append([start + e for e in ends if e <= overlap])
                tail.append([] if following is None else [start + e for e in clean(text.as_py(), pattern, ends, following - start)])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (head, tail)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "k", "start", "next")), *lists], names=["row", "k", "start", "next", "head", "tail"])

    src = chunks.select("row", "k", "start", "next", "text")
    return src.mapInArrow(run, "row long, k long, start long, next long, head array<long>, tail array<long>")


def _stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Chunks with `begin` and `stop`, where the piece that each of them stands for lies in the whole text (stop is null at its end)."""
    while True:
        ends = written(_ends(chunks, pattern, overlap), "ends")
        before = ends.select("row", F.col("next").alias("start"), F.col("tail").alias("other"))
        met = ends.join(before, ["row", "start"], "left").withColumn("begin", F.array_min(F.array_intersect("head", "other")))
        met = met.select("row", "k", "start", (F.col("start") > 0).alias("later"), F.when(F.col("start") == 0, 0).otherwise(F.col("begin")).alias("begin"), "next")
        met = written(met, "stitches")
        if met.where("begin is null").isEmpty():
            break
        chunks = written(_joined(chunks, met), "chunks")
    stop = met.where("later").select("row", F.col("start").alias("next"), F.col("begin").alias("stop"))
    pieces = met.select("row", "k", "begin", "next").join(stop, ["row", "next"], "left").select("row", "k", "begin", "stop")
    return chunks.join(pieces, ["row", "k"])


def _joined(chunks: DataFrame, met: DataFrame) -> DataFrame:
    """Each run of chunks that share no place with the one before them becomes one chunk."""
    from pyspark.sql import Window

    # one small row for each chunk, no text
    order = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    runs = met.select("row", "k", F.max(F.when(F.col("begin").isNotNull(), F.col("k"))).over(order).alias("run"))
    large = runs.groupBy("row", "run").agg(F.count("*").alias("n")).where("n > 1").select("row", "run")
    of = written(runs.join(large, ["row", "run"]), "runs")
    own = F.when(F.col("next").isNull(), F.col("text")).otherwise(F.expr("substring(text, 1, next - start)"))
    rows = chunks.join(of, ["row", "k"]).withColumn("own", own)
    parts = F.array_sort(F.collect_list(F.struct("k", "own")))
    last = F.max_by(F.struct("next", "text", "start"), "k")
    merged = rows.groupBy("row", "run").agg(F.first("kept").alias("kept"), F.min("start").alias("start"), parts.alias("parts"), last.alias("last"))
    rest = F.when(F.col("last.next").isNotNull(), F.expr("substring(last.text, last.next - last.start + 1)")).otherwise(F.lit(""))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["own"]), ""), rest)
    one = merged.select("kept", "row", F.col("run").alias("k"), "start", F.col("last.next").alias("next"), text.alias("text"))
    return chunks.join(of, ["row", "k"], "left_anti").select(*one.columns).unionByName(one)


def _encoded(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """(kept, row, piece, text) with ids in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            at, size, ids = 0, 0, []
            texts = b.column("text")
            for i in range(len(texts)):
                ids.append(np.array(enc.encode_ordinary(texts[i].as_py() or ""), "<u4").tobytes())
                size += len(ids[-1])
                if size >= HAND_ON or i == len(texts) - 1:
                    part = b.slice(at, len(ids))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("kept", "row", "piece")), pa.array(ids, pa.binary())], names=["kept", "row", "piece", "ids"])
                    at, size, ids = i + 1, 0, []

    src = pieces.select("kept", "row", "piece", "text")
    return src.mapInArrow(run, StructType([src.schema[c] for c in ("kept", "row", "piece")]).add("ids", "binary"))


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    own = [F.col("kept").getField(c).alias(c) for c in rows.schema["kept"].dataType.names if c != _NONE]
    return rows.select(*own, *more)


_NONE = "__none"


def _kept(docs: DataFrame, text_col: str, gone: tuple[str, ...]) -> Column:
    names = [c for c in docs.columns if c.lower() not in {text_col.lower(), *gone}]
    return F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0).alias(_NONE))


def _branches(docs: DataFrame, path: str, pattern: str, text_col: str, gone: tuple[str, ...], chunk: int, overlap: int) -> list[DataFrame]:
    """(kept, row, piece, ids): texts of one piece each where they lie, then the longer ones, sorted by row and piece."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    src = docs.select(_kept(docs, text_col, gone).alias("kept"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    number = F.monotonically_increasing_id()
    short = src.where(F.length("text") <= chunk).select("kept", "text", (number * 2).alias("row"), F.lit(0).cast("long").alias("piece"))
    long = src.where(F.length("text") > chunk).select("kept", "text", (number * 2 + 1).alias("row"))
    # the rows are written, so their numbers hold from here on, and dealt out by chunk
    chunks = written(_chunked(long, chunk, overlap).repartition("row", "k"), "chunks")
    cut = F.expr("substring(text, begin - start + 1, coalesce(stop - begin, length(text)))")
    pieces = _stitched(chunks, pattern, overlap).select("kept", "row", F.col("k").alias("piece"), cut.alias("text"))
    dealt = _encoded(pieces, path, pattern).repartition("row").sortWithinPartitions("row", "piece")
    return [_encoded(short, path, pattern), dealt]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece of a text: the columns of docs but the text, row, piece, ids.

    `row` tells rows of docs apart (it is no stable id), `piece` ascends within a text and may skip numbers, `ids` holds
    unsigned 32-bit numbers, lowest byte first. Columns of docs with these names, in upper or lower case, are replaced.
    A null text counts as empty and has one piece without ids; repeated rows stay apart. The rank file is opened by every
    worker at `path`. Results read tables in the shared folder.
    """
    short, long = _branches(docs, path, pattern, text_col, OUT, chunk, overlap)
    return _flat(short, *OUT).unionByName(_flat(long, *OUT))


def decode(pieces: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds the bytes that the ids of each row stand for; those of a text are the bytes of its pieces in order. Null ids give null."""
    names = [c for c in pieces.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            data = [None if x.as_py() is None else enc.decode_bytes(np.frombuffer(x.as_py(), "<u4").tolist()) for x in b.column(names.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*names, out])

    src = pieces.select(*(F.col(f"`{c}`") for c in names))
    return src.mapInArrow(run, StructType(list(src.schema.fields)).add(out, "binary"))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _digests(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each text. Its pieces follow each other in one partition; only the running digests are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        row, last, n, sums = None, None, 0, []

        def done(kept: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            count, ids, data = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([kept, pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=["kept", *DIGESTS])

        for b in batches:
            kept, at, found = b.column("kept"), [], []
            for i, (r, x) in enumerate(zip(b.column("row").to_pylist(), b.column("ids"), strict=True)):
                if r != row:
                    if row is not None:
                        result = (n, *(s.hexdigest() for s in sums))
                        if i:
                            at.append(i - 1)
                            found.append(result)
                        else:
                            yield done(last, [result])
                    row, n, sums = r, 0, [hashlib.sha256(), hashlib.sha256()]
                ids = x.as_py()
                sums[0].update(ids)
                sums[1].update(enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()))
                n += len(ids) // 4
            if found:
                yield done(kept.take(pa.array(at)), found)
            if len(kept):
                last = kept.take(pa.array([len(kept) - 1]))
        if row is not None:
            yield done(last, [(n, *(s.hexdigest() for s in sums))])

    schema = StructType([pieces.schema["kept"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return pieces.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs: its columns but the text, n_tokens, ids_sha256 and decoded_sha256.

    The digests are those of all ids of the text (unsigned 32-bit numbers, lowest byte first) and of the bytes that they
    decode to. A null or empty text has no ids. Columns of docs with these names, in upper or lower case, are replaced.
    """
    both = [_digests(x, path, pattern) for x in _branches(docs, path, pattern, text_col, DIGESTS, chunk, overlap)]
    return _flat(both[0], *DIGESTS).unionByName(_flat(both[1], *DIGESTS))
