"""Near copies by the Jaccard similarity of their five-word shingles.

Documents at similarity 0.8 differ in about 15 % of their SimHash bits, which is more than one bit a byte at any
length, so no SimHash keeps a byte-position filter whole there. The sketch is therefore one of minima: 128 of them,
posted in 32 picks of four. A pair at similarity 0.8 meets in at least one pick with probability 1 - 5e-8, a closer pair
with more; pairs that meet are verified on their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tapewatch.llm import tokens
from tapewatch.llm.common import components, dealt, removed, scratch, small, surplus, union_all, widened, written
from tapewatch.llm.simhash import fingerprint

WORDS = 5
#: Two documents are near copies from this similarity, as a fraction.
LEAST = (4, 5)
ROWS, PICKS = 4, 32
#: Posting lists with more members and more than one group get further stars before what is left is joined.
CROWDED, STARS = 256, 2
#: Members of longer lists of a rare shingle meet by what they do not share with a hub instead.
LISTED = 64
CHUNK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(17))
_TIMES = _RNG.integers(0, 1 << 63, ROWS * PICKS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, ROWS * PICKS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    if not n:
        return h
    size = len(h) - n + 1
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total = (total ^ h[k : k + size]) * _MIX
        total ^= total >> np.uint64(31)
    return np.unique(total)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def sketch(s: np.ndarray) -> np.ndarray:
    """One number for each pick of minima."""
    least = np.full(ROWS * PICKS, ~np.uint64(0))
    for at in range(0, len(s), CHUNK):
        np.minimum(least, (_TIMES[:, None] * s[None, at : at + CHUNK] + _PLUS[:, None]).min(1), out=least)
    m, out = least.reshape(PICKS, ROWS), np.arange(1, PICKS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ m[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketched(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, id, __fp, __key, __picks) of numbered rows: the SimHash fingerprint, a key for each shingle set (0 where it is empty) and the sketch."""
    src = rows.select("__row", F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()  # a worker that has packed before holds them
        for b in batches:
            fps, keys, picks = [], [], []
            for t in b.column(2):
                text = t.as_py()
                s = shingle_set(text)
                fps.append(fingerprint(text))
                keys.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0)
                picks.append(sketch(s) if len(s) else [])
            cols = [pa.array(fps, pa.int64()), pa.array(keys, pa.int64()), pa.array(picks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["__row", "id", "__fp", "__key", "__picks"])

    return src.mapInArrow(run, widened(src.select("__row", "id"), __fp="long", __key="long", __picks=ArrayType(LongType())))


def verified(pairs: DataFrame, kinds: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """Pairs (u, v) of set keys whose similarity is high enough."""
    spark, met_at, texts_at = pairs.sparkSession, scratch(pairs.sparkSession, "met"), scratch(pairs.sparkSession, "met-texts")
    pairs = written(pairs.distinct(), "met", met_at)
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    need = small(written(keys.join(kinds.select("key", "row"), "key"), "met-rows"))
    texts = dealt(written(rows.join(need, rows["__row"] == need["row"]).select("key", F.col(f"`{text_col}`").alias("text")), "met-texts", texts_at))
    met = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("key").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # rows of one u often follow each other
        for b in batches:
            good = []
            for u, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if own is None or u != last:
                    last, own = u, shingle_set(x.as_py())
                good.append(alike(own, shingle_set(y.as_py())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    near = written(met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "near")
    removed(spark, met_at, texts_at)
    return near


def prefix_pairs(members: DataFrame, kinds: DataFrame, rows: DataFrame, text_col: str, listed: int | None = None) -> DataFrame:
    """Pairs (u, v) of different label among members (key, label): every near pair is one of them, or both are paired with one text near to both.

    Each set is put in one order, rare shingles first. Of a near pair, the smaller set A has its first shared shingle
    among the first |A| / 9 + 1 and the larger set B among the first |B| / 5 + 1, as they share 8/9 of |A| at least and
    4/5 of |B|; what follows it in either must hold the whole overlap. Texts that differ by more in shingles of their own
    meet nobody, however many share the rest. Members of lists longer than `listed` meet by what they do not share
    with a hub, see `apart_pairs`.
    """
    listed = listed or LISTED
    spark, sets_at, posts_at = members.sparkSession, scratch(members.sparkSession, "sets"), scratch(members.sparkSession, "prefixes")
    need = small(written(members.join(kinds.select("key", "row"), "key"), "members"))
    src = rows.select("__row", F.col(f"`{text_col}`").alias("text")).join(need.withColumnRenamed("row", "__row"), "__row").select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["key", "label", "set"])

    sets = written(src.mapInArrow(run, "key long, label long, set array<long>"), "sets", sets_at)
    items = sets.select("key", "label", F.size("set").alias("n"), F.explode("set").alias("s"))
    ordered = items.join(dealt(items.groupBy("s").agg(F.count("*").alias("times"))), "s").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("times", "s")) - 1)
    posts = written(ordered.where("times > 1 and at <= floor(n / 5)").select("s", "key", "label", "n", "at"), "prefixes", posts_at)
    mixed = posts.groupBy("s").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s", "size")
    posts = posts.join(dealt(mixed), "s")
    a, b = (posts.where(F.col("size") <= listed).select("s", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "label", "n", "at"))) for k in "ab")
    met = a.where("at_a <= floor(n_a / 9)").join(dealt(b), "s").where("label_a <> label_b and (n_a < n_b or n_a = n_b and key_a <> key_b) and 5 * n_a >= 4 * n_b")
    met = met.where("9 * least(n_a - at_a, n_b - at_b) >= 4 * (n_a + n_b)")
    found = [written(met.select(F.least("key_a", "key_b").alias("u"), F.greatest("key_a", "key_b").alias("v")).distinct(), "prefix-pairs")]
    full_at = scratch(spark, "crowded-lists")
    full = written(posts.where(F.col("size") > listed).select("s", "key"), "crowded-lists", full_at)
    if not full.isEmpty():
        found.append(apart_pairs(full, sets))
    removed(spark, sets_at, posts_at, full_at)
    return union_all(found)


def apart_pairs(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of different label among the members of each list (s, key): every near pair, or two pairs that join it.

    Of the members of a list and of the lists that share members with it, the one in most lists is the list's hub; lists
    with the same hub are one. Let D(A) be the shingles in either A or the hub, but not in both: D(A) and D(B) differ
    where A and B do, in (|A| + |B|) / 9 shingles at most if the pair is near. Either D(A) and D(B) have no more than
    that together; then A and B are both near the hub, and paired with it. Or they overlap and meet by prefixes, as in
    `prefix_pairs`, what few members differ in first. So texts do not meet for what most of their list has.
    """
    spark, apart_at, posts_at = posts.sparkSession, scratch(posts.sparkSession, "apart"), scratch(posts.sparkSession, "prefixes")
    top = posts.groupBy("key").agg(F.count("*").alias("lists")).select("key", F.struct("lists", "key").alias("hub"))
    for on, by in (("key", "s"), ("s", "key"), ("key", "s")):
        top = posts.join(dealt(top), on).groupBy(by).agg(F.max("hub").alias("hub"))
    held = posts.join(dealt(top), "s").select(F.col("hub.key").alias("hub"), "key").distinct()
    theirs = sets.select(F.col("key").alias("hub"), F.col("set").alias("other"), F.col("label").alias("own"))
    both = held.join(dealt(sets), "key").join(dealt(theirs), "hub")
    d = F.concat(F.array_except("set", "other"), F.array_except("other", "set"))
    apart = written(both.select("hub", "key", "label", "own", F.size("set").alias("n"), F.size("other").alias("m"), d.alias("d")), "apart", apart_at)
    near = apart.where("label <> own and 9 * size(d) <= n + m").select(F.least("hub", "key").alias("u"), F.greatest("hub", "key").alias("v"))
    items = apart.select("hub", "key", "label", "n", F.size("d").alias("d"), F.explode("d").alias("s"))
    times = items.groupBy("hub", "s").agg(F.count("*").alias("times"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ordered = items.join(dealt(times), ["hub", "s"]).withColumn("at", F.row_number().over(Window.partitionBy("hub", "key").orderBy("times", "s")) - 1)
    # of near sets one has at most 5/4 of the other's shingles, so they differ in a quarter of either at most
    kept = written(ordered.where("lo <> hi and at <= floor(n / 4)").select("hub", "s", "key", "label", "n", "d", "at"), "prefixes", posts_at)
    a, b = (kept.select("hub", "s", *(F.col(c).alias(f"{c}_{k}") for c in ("key", "label", "n", "d", "at"))) for k in "ab")
    met = a.where("at_a <= floor(n_a / 8)").join(dealt(b), ["hub", "s"]).where("label_a <> label_b and (d_a < d_b or d_a = d_b and key_a <> key_b) and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    met = met.where("9 * (d_a + d_b) > n_a + n_b and 18 * least(d_a - at_a, d_b - at_b) >= 9 * (d_a + d_b) - n_a - n_b")
    pairs = written(near.union(met.select(F.least("key_a", "key_b").alias("u"), F.greatest("key_a", "key_b").alias("v"))).distinct(), "apart-pairs")
    removed(spark, apart_at, posts_at)
    return pairs


def merged(groups: DataFrame | None, near: DataFrame) -> DataFrame:
    """(node, label) of components of near pairs (u, v) and those found before: only links between labels go through the rounds."""
    if groups is None:
        return components(near)
    by = lambda c: groups.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    named = near.join(by("u"), "u", "left").join(by("v"), "v", "left").select("u", "v", F.coalesce("of_u", "u").alias("of_u"), F.coalesce("of_v", "v").alias("of_v"))
    named = written(named, "named")
    ends = named.select(F.col("u").alias("node"), F.col("of_u").alias("label")).union(named.select("v", "of_v"))
    step = components(named.select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v")).distinct())
    step = step.select(F.col("node").alias("label"), F.col("label").alias("now"))
    return written(groups.union(ends).distinct().join(step, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "groups")


def links(kinds: DataFrame, rows: DataFrame, text_col: str = "text", crowded: int = CROWDED, met: DataFrame | None = None) -> DataFrame:
    """(node, label) for set keys that are linked: every pair that meets and is near is joined by links.

    Pairs (u, v) of `met` are verified first. Then all members of a posting list that holds more than one group are held
    against one of them. Only lists that still have more than one group go on, crowded ones with further stars; then the
    members of those lists are joined by their rarest shingles, see `prefix_pairs`.
    """
    posts = kinds.select("key", F.explode("picks").alias("pick"))
    lists = posts.groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select("pick")
    posts = written(posts.join(dealt(lists), "pick", "left_semi"), "posts")

    def open_lists(name: str) -> DataFrame:
        named = posts.join(groups, posts["key"] == groups["node"], "left").select("pick", "key", F.coalesce("label", "key").alias("label"))
        sizes = named.groupBy("pick").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        return written(named.join(dealt(sizes.select("pick", "n")), "pick"), name)

    groups = merged(None, kinds.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0) if met is None else verified(met, kinds, rows, text_col))
    todo = open_lists("open")
    for r in count():
        hub = todo.groupBy("pick").agg(F.min(F.struct(F.xxhash64("pick", "key", F.lit(r)).alias("h"), F.col("key").alias("hub"), F.col("label").alias("own"))).alias("x")).select("pick", "x.hub", "x.own")
        star = todo.join(dealt(hub), "pick").where("label <> own").select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v"))
        groups = merged(groups, verified(star, kinds, rows, text_col))
        left = open_lists("open")
        todo = left.where(F.col("n") > crowded)
        if r + 1 >= STARS or todo.isEmpty():
            break
    if left.isEmpty():
        return groups
    last = verified(prefix_pairs(left.select("key", "label").distinct(), kinds, rows, text_col), kinds, rows, text_col)
    return groups if last.isEmpty() else merged(groups, last)


def copies(rows: DataFrame, own: DataFrame, text_col: str = "text", crowded: int = CROWDED, met: DataFrame | None = None) -> DataFrame:
    """(__row) of numbered rows that are near copies: of each component of links one document stays, see `surplus`.

    own: the table of `sketched`. Texts without words are copies of each other. Rows that share a label in `met`
    (__row, label), the number of one of them, are held against that one before any others.
    """
    first = own.groupBy("__key").agg(F.min_by("__picks", "__row").alias("picks"), F.min("__row").alias("row"))
    kinds = written(first.select(F.col("__key").alias("key"), "row", "picks"), "kinds")
    if met is not None:
        keys = own.select("__row", "__key")
        met = met.join(keys, "__row").select("label", F.col("__key").alias("v")).join(keys.select(F.col("__row").alias("label"), F.col("__key").alias("u")), "label")
        met = met.where("u <> v and u <> 0 and v <> 0").select("u", "v")
    groups = links(kinds, rows, text_col, crowded, met)
    return surplus(written(own.join(groups, own["__key"] == groups["node"], "left").select("__row", "id", F.coalesce("label", "__key").alias("label")), "groups"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays.

    Rows that share an id count as one document and stay or go together. A row without an id is a document of its own;
    where a component has no id at all, one of its rows stays. Texts without words are copies of each other.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    gone = copies(rows, written(sketched(rows, id_col, text_col), "sketches"), text_col, crowded)
    return rows.join(small(gone), "__row", "left_anti").select(*docs.columns)
