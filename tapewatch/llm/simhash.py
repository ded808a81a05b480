"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits share at
least five of them, hence at least four of the first seven; so every fingerprint is posted under each choice of
four of its first seven positional bytes, postings that meet are tallied, pairs that share fewer than five
positional bytes fall away and the rest are verified bit by bit. A pair is reported by one posting list only:
that of the first four positions it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import components, dealt, small, union_all, written

MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
PREFIX = 7
PICKS = list(combinations(range(PREFIX), PREFIX - MAX_BITS))
#: The five positions under which the members of a crowded list are posted again.
FIVES = list(combinations(range(8), SHARED_BYTES))
#: Posting lists above this many fingerprints are split by a further position.
CROWDED = 256
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """SimHash as a signed 64-bit number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle_words: int = 3, out: str = "fp") -> DataFrame:
    """All columns of docs except the text, plus the fingerprint as a long."""
    keep = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            fps = pa.array([fingerprint(t.as_py(), shingle_words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), fps], names=[*keep, out])

    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("__text"))
    schema = src.select(*(F.col(f"`{c}`") for c in keep)).schema.add(out, "long")
    return src.mapInArrow(run, schema)


def _postings(fps: DataFrame) -> DataFrame:
    """(pick, key, fp): one row for each choice of positions."""
    rows = [F.struct(F.lit(k).cast("short").alias("pick"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for k, p in enumerate(PICKS)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.pick", "x.key", "fp")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _first_pick(picks: list[tuple[int, ...]]) -> list[int]:
    """For each set of shared positions, as bits, the pick that is its lowest positions; -1 if there is none."""
    at, size = {p: k for k, p in enumerate(picks)}, len(picks[0])
    return [at.get(tuple([i for i in range(8) if m >> i & 1][:size]), -1) for m in range(1 << 8)]


def _shared(x: Column, n: int) -> Column:
    """Bits of the positions at which a XOR has a zero byte."""
    bits = [F.when(x.bitwiseAND(F.lit(_mask((i,)))) == 0, 1 << i).otherwise(0) for i in range(n)]
    return sum(bits[1:], bits[0])


def linked_fingerprints(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp: every pair within three bits is linked, or joined by such links.

    Posting lists of up to `crowded` members yield their pairs. Longer lists are split by the byte of each later
    position: a pair shares five positions, so it meets again in the list of the lowest five. What is crowded even
    there agrees in 40 bits; those members are linked through stars: for a variant w, all fingerprints within two
    bits of w are linked to the smallest one within one bit of it. Two fingerprints three bits apart share such a
    star, so components are the same as with all pairs.
    """
    posts = _postings(fps)
    full = _crowded(posts, crowded, "crowded")
    if full.isEmpty():
        return _pairs(posts, PICKS)
    full = small(full)
    split = _split(posts.join(full, ["pick", "key"], "left_semi"))
    links = [_pairs(posts.join(full, ["pick", "key"], "left_anti"), PICKS)]
    dense = _crowded(split, crowded, "dense")
    if dense.isEmpty():
        return union_all([*links, _pairs(split, FIVES)])
    dense = small(dense)
    members = written(split.join(dense, ["pick", "key"], "left_semi").select("fp").distinct(), "members")
    return union_all([*links, _pairs(split.join(dense, ["pick", "key"], "left_anti"), FIVES), _stars(members)])


def _crowded(posts: DataFrame, crowded: int, name: str) -> DataFrame:
    return written(posts.groupBy("pick", "key").count().where(F.col("count") > crowded).select("pick", "key"), name)


def _split(posts: DataFrame) -> DataFrame:
    """Postings of crowded lists under each further position behind their last one."""
    at = {p: k for k, p in enumerate(FIVES)}
    further = [[at[(*p, e)] for e in range(p[-1] + 1, 8)] for p in PICKS]
    picks = F.element_at(F.array(*(F.array(*(F.lit(k).cast("short") for k in f)) for f in further)), F.col("pick") + 1)
    mask = F.element_at(F.array(*(F.lit(_mask(p)) for p in FIVES)), F.col("five") + 1)
    return posts.select("fp", F.explode(picks).alias("five")).select(F.col("five").alias("pick"), F.col("fp").bitwiseAND(mask).alias("key"), "fp")


def _pairs(posts: DataFrame, picks: list[tuple[int, ...]]) -> DataFrame:
    """Pairs of each posting list: their shared positional bytes are tallied, pairs below the least number fall away,
    the list of the lowest shared positions reports the pair, and the bits are verified."""
    a, b = posts.select("pick", "key", F.col("fp").alias("u")), posts.select("pick", "key", F.col("fp").alias("v"))
    met = a.join(dealt(b), (a["pick"] == b["pick"]) & (a["key"] == b["key"]) & (F.col("u") < F.col("v"))).select(a["pick"], "u", "v")
    x = F.col("u").bitwiseXOR(F.col("v"))
    shared = _shared(x, 8)
    first = F.element_at(F.array(*(F.lit(k) for k in _first_pick(picks))), shared + 1)
    tallied = met.where(F.bit_count(shared) >= SHARED_BYTES).where(first == F.col("pick"))
    return tallied.where(F.bit_count(x) <= MAX_BITS).select("u", "v")


def _stars(members: DataFrame) -> DataFrame:
    one = [1 << i for i in range(64)]
    two = [a | b for a, b in combinations(one, 2)]
    signed = lambda ms: [m - (1 << 64) if m >= 1 << 63 else m for m in ms]
    near = signed([0, *one])

    def variants(masks: list[int]) -> DataFrame:
        flips = F.array(*(F.lit(m).cast("long") for m in masks))
        return members.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("w"), "fp")

    hub = variants(near).groupBy("w").agg(F.min("fp").alias("u"))
    return variants([*near, *signed(two)]).join(dealt(hub), "w").where("u <> fp").select("u", F.col("fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row for each document: id, fp (long) and component_id, the smallest id reachable through links.

    Texts that are null, empty or without words have fingerprint 0 and are linked with each other. A row without
    an id takes part like any other; component_id is null only where no member has an id. Repeated rows stay.
    Columns of docs other than id and text are not looked at.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return group(written(fingerprints(ids), "fingerprints"), crowded).withColumnRenamed("id", id_col)


def group(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Adds component_id to rows (id, fp, ...)."""
    kinds = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "kinds")
    links = components(linked_fingerprints(kinds.select("fp"), crowded))
    named = links.select(F.col("node").alias("fp"), "label").join(kinds, "fp")
    found = written(named, "linked")
    roots = found.groupBy("label").agg(F.min("least").alias("root"))
    linked = found.join(roots, "label").select("fp", "root")
    of = written(kinds.join(linked, "fp", "left").select("fp", F.coalesce("root", "least").alias("component_id")), "components")
    return fps.join(of, "fp").select(*fps.columns, "component_id")


def linked_rows(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(__row, label) of numbered fingerprints (__row, fp): label is the smallest number reachable through links."""
    return group(fps.withColumnRenamed("__row", "id"), crowded).select(F.col("id").alias("__row"), F.col("component_id").alias("label"))
