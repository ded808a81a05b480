"""Packing documents into fixed windows by minimum bin slack.

Documents are tokenized once and cut at multiples of the window; full pieces are windows of their own. The rest is
dealt evenly over groups of a bounded size. In a group, the longest remaining piece opens a window and a bitset
subset-sum program over the remaining lengths (binary-split counts) finds the multiset that comes closest to the
capacity; its layers are walked back to the counts of each length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import written
from tapewatch.llm.tokens import BATCH, ENTRIES, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces that one task packs at a time.
GROUP = 4096


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", entries: int = ENTRIES, batch: int = BATCH) -> DataFrame:
    """Token pieces of whole documents, cut at multiples of the window: (doc_id, start, length, ids_crc32, doc_tokens).

    A null text is empty; with an end id even an empty document has one id. Without one it has no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, entries=entries, batch=batch)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(t.as_py() for t in b.column(1)), strict=True):
                ids = ids.astype("<u4")
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum of a sub-multiset of counts (length: how many) that fits, and the lengths it takes."""
    reach, mask, layers = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, take = left - take, take * 2
        if reach >> capacity & 1:
            break
    best = rest = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> rest & 1:
            used[length] = used.get(length, 0) + take
            rest -= length * take
    return best, used


def fill_windows(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window number and the offset in it of each length (1 to window)."""
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for k in order[::-1].tolist():
        waiting.setdefault(int(lengths[k]), []).append(k)
    counts = {n: len(x) for n, x in waiting.items()}
    place, offset, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while counts:
        seed = max(counts)
        less = {**counts, seed: counts[seed] - 1} if counts[seed] > 1 else {n: c for n, c in counts.items() if n != seed}
        total, used = best_fill(less, window - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[n] // c for n, c in used.items()) if total + seed == window else 1
        for _ in range(times):
            pos = 0
            for n in sorted(used, reverse=True):
                for _ in range(used[n]):
                    k = waiting[n].pop()
                    place[k], offset[k] = at, pos
                    pos += n
            at += 1
        for n, c in used.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    return place, offset


def pack(parts: DataFrame, window: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `window` ids; in a sequence, offsets follow without gaps.

    Full pieces are sequences of their own, numbered from 2**62. The others are dealt over groups by their place in the
    table, so equal rows, ties and null ids spread as well; a group leaves at most its last few windows partly filled.
    An empty table gives an empty one.
    """
    parts = written(parts, "pieces")
    full = parts.where(F.col("length") == window).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id())
    rest = parts.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        place, offset = fill_windows(pdf["length"].to_numpy(np.int64), window)
        return pdf.drop(columns="grp").assign(sequence_id=(int(key[0]) << 32) + place, offset=offset)

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(run, PIECES + ", sequence_id long, offset long")
    return packed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, entries: int = ENTRIES, batch: int = BATCH) -> DataFrame:
    """Tokenizes, cuts and packs whole documents. Other columns of docs are not looked at."""
    return pack(pieces(docs, tokenizer, window, end_id, id_col, text_col, entries, batch), window, group)
