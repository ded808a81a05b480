"""The strongest word phrases of each language, by best-first growth with bounds.

A phrase grows to the right. Its score is that of its weakest cut into two parts, floor(1000 * a * n / (l * r)), and the
right part of a cut behind the first k words occurs at least as often as the whole; so no phrase with this beginning can
score above 1000 * n over the count of its first word, the most frequent of its beginnings. The frontier holds frequent
phrases that have not grown yet. A round takes those with the best bounds, reads the corpus once and counts what they grow
into; it also counts right parts whose count is missing, and looks at the words around phrases that may be in the result.
Rounds end when no bound reaches the last score that is kept, ties included.

A word is known by 64 bits that hash it and its language; that no two words share them is checked for the whole
vocabulary, else other bits are drawn. A phrase is the bytes of its words. Filters that the tasks get are bit arrays of a
fixed size: what they let through by mistake falls below the least count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import removed, scratch, written

LEAST = 100
TOP = 2000
LONGEST = 5
#: Phrases of a language that grow in the first round; each later round takes four times as many.
STEP = 50_000
#: Bits of each filter.
BITS = 1 << 25
#: Bytes of text that are looked at together, and phrases that a task counts before it hands them on.
PART = 1 << 20
ENTRIES = 500_000

# White space between words, and what ends a piece.
_BLANK, _END = b" \t", b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_BLANK)] = 1
_CLASS[list(_END)] = 2
_WORD = re.compile(rb"[^" + re.escape(_BLANK + _END) + rb"]+")
_GAP = re.compile(rb"[" + re.escape(_BLANK + _END) + rb"]")
_NEAR = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of phrases by one more word."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes)


def _phrase_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of phrases of as many words as there are rows."""
    h = _mix(codes[0])
    for c in codes[1:]:
        h = _grow(h, c)
    return h


class Coder:
    """Codes of the words of texts."""

    def __init__(self, salt: int):
        self.salt = np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))
        self.near = _mix(np.arange(_NEAR * 256, dtype=np.uint64) + self.salt)
        self.seeds: dict[str, np.uint64] = {}

    def seed(self, lang: str) -> np.uint64:
        if lang not in self.seeds:
            if len(self.seeds) > 10_000:
                self.seeds.clear()
            digest = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            self.seeds[lang] = np.frombuffer(digest, np.uint64)[0]
        return self.seeds[lang]

    def batches(self, rows: Iterator[tuple[str, str]]) -> Iterator[Batch]:
        """Batches of (language, text); texts are in lower case by A to Z alone. Long texts are cut between words."""
        waiting, size = [], 0
        for lang, text in rows:
            for part in _parts(text.encode("utf-8", "surrogatepass").lower()):
                waiting.append((lang, *part))
                size += len(part[0])
                if size >= PART:
                    yield Batch(self, waiting)
                    waiting, size = [], 0
        if waiting:
            yield Batch(self, waiting)


def _parts(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, words before, words behind): a long text in parts, each with one word before it and up to five behind."""
    at, lead = 0, None  # where the part begins, and the last word before it
    while len(data) - at > PART and (gap := _GAP.search(data, at + PART)):
        end = tail = gap.start()
        behind = 0
        for m in _WORD.finditer(data, end):
            behind, tail = behind + 1, m.end()
            if behind == LONGEST:
                break
        yield data[at if lead is None else lead : tail], int(lead is not None), behind
        k = end
        while k > at and _CLASS[data[k - 1]]:
            k -= 1
        if k > at:
            lead = k
            while lead > at and not _CLASS[data[lead - 1]]:
                lead -= 1
        at = end
    yield data[at if lead is None else lead :], int(lead is not None), 0


class Batch:
    """Words of some texts in order: `codes` and `piece` with LONGEST zeros behind, `own` where a word is to be counted."""

    def __init__(self, coder: Coder, parts: list[tuple[str, bytes, int, int]]):
        self.langs = [p[0] for p in parts]
        self.data = b"\n".join(p[1] for p in parts)
        buf = np.frombuffer(self.data, np.uint8)
        kind = _CLASS[buf]
        word = kind == 0
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(self.start)
        begin = np.cumsum([0, *(len(p[1]) + 1 for p in parts)])
        self.part = np.searchsorted(begin, self.start, "right") - 1
        self.own = np.ones(self.n, bool)
        for k, (_, _, before, behind) in enumerate(parts):
            if before or behind:
                lo, hi = np.searchsorted(self.start, begin[k : k + 2])
                self.own[lo : lo + before] = self.own[hi - behind : hi] = False
        self.codes, self.piece = np.zeros(self.n + LONGEST, np.uint64), np.full(self.n + LONGEST, -1)
        if not self.n:
            return
        at = np.flatnonzero(word)
        length = self.stop - self.start
        first = np.cumsum(length) - length
        inside = np.arange(len(at)) - np.repeat(first, length)
        mixed = coder.near[np.minimum(inside, _NEAR - 1) * 256 + buf[at]]
        far = np.flatnonzero(inside >= _NEAR)
        mixed[far] = _mix((inside[far] * 256 + buf[at[far]]).astype(np.uint64) + coder.salt)
        seeds = np.array([coder.seed(g) for g in self.langs], np.uint64)
        codes = _mix(np.add.reduceat(mixed, first) ^ seeds[self.part])
        codes[codes == 0] = 1  # zero stands for no word
        self.codes[: self.n] = codes
        self.piece[: self.n] = np.cumsum(kind == 2)[self.start]

    def windows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length its number, where such a phrase begins (own, within a piece), and the hashes of all positions."""
        h = _mix(self.codes)
        for m in range(1, LONGEST + 1):
            if m > 1:
                h = _grow(h[:-1], self.codes[m - 1 :])
            yield m, self.own & (self.piece[: self.n] == self.piece[m - 1 : self.n + m - 1]), h

    def phrases(self, at: np.ndarray, m: int) -> np.ndarray:
        return np.stack([self.codes[at + k] for k in range(m)])

    def around(self, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The words before and behind phrases, 0 where the piece ends."""
        left, right = np.where(at > 0, self.codes[at - 1], 0), self.codes[at + m]
        left[self.piece[at - 1] != self.piece[at]] = 0
        right[self.piece[at + m] != self.piece[at]] = 0
        return left.view(np.int64), right.view(np.int64)


def _kinds(h: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each kind of phrase, and the number of each phrase's kind; equal hashes alone do not count."""
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    if (codes[:, first][:, kind] != codes).any():
        rows = np.ascontiguousarray(codes.T).view(np.dtype((np.void, 8 * len(codes)))).ravel()
        _, first, kind = np.unique(rows, return_index=True, return_inverse=True)
    return first, kind


class _Tally:
    """Counts of phrases of one length, or the least and greatest words around them."""

    def __init__(self, m: int, columns: int):
        self.m, self.h, self.codes, self.values = m, [], [], [[] for _ in range(columns)]
        self.size = 0

    def add(self, h: np.ndarray, codes: np.ndarray, *values: np.ndarray) -> None:
        if len(h):
            self.h.append(h)
            self.codes.append(codes)
            for own, v in zip(self.values, values, strict=True):
                own.append(v)
            self.size += len(h)

    def shrink(self) -> None:
        if len(self.h) < 2 and self.size <= ENTRIES:
            return
        h, codes = np.concatenate(self.h), np.concatenate(self.codes, axis=1)
        first, kind = _kinds(h, codes)
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order], prepend=-1))
        folds = [np.add] if len(self.values) == 1 else [np.minimum, np.maximum, np.minimum, np.maximum]
        values = [f.reduceat(np.concatenate(v)[order], cuts) for f, v in zip(folds, self.values, strict=True)]
        self.h, self.codes, self.values, self.size = [h[first]], [codes[:, first]], [[v] for v in values], len(first)

    def rows(self) -> pa.RecordBatch:
        self.shrink()
        codes = np.ascontiguousarray(np.concatenate(self.codes, axis=1).T)
        keys = _keys(codes)
        n = len(codes)
        values = [pa.array(np.concatenate(v).astype(np.int64)) for v in self.values]
        none = pa.nulls(n, pa.int64())
        columns = [*values, none, none, none, none] if len(values) == 1 else [none, *values]
        self.__init__(self.m, len(self.values))
        return pa.RecordBatch.from_arrays([keys, *columns], names=_FOUND)


_FOUND = ["key", "n", "left_least", "left_most", "right_least", "right_most"]


def _keys(codes: np.ndarray) -> pa.Array:
    """Phrases (rows of codes) as binary values."""
    n, m = codes.shape
    offsets = (np.arange(n + 1) * 8 * m).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(codes.tobytes())])


def _codes(keys: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, m).T


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            yield lang.as_py(), text.as_py()


def _words(docs: DataFrame, salt: int) -> DataFrame:
    """(lang, word, code, n) of the whole vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Coder(salt).batches(_rows(batches)):
            own = np.flatnonzero(b.own)
            if len(own):
                code, first, n = np.unique(b.codes[own], return_index=True, return_counts=True)
                at = own[first]
                words = [b.data[s:e] for s, e in zip(b.start[at].tolist(), b.stop[at].tolist(), strict=True)]
                langs = [b.langs[k] for k in b.part[at].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "word", "code", "n"],
                )

    found = _texts(docs).mapInArrow(run, "lang string, word string, code long, n long")
    return found.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def _filters(marked: DataFrame, bits: int) -> dict[str, np.ndarray]:
    """Bit arrays of a fixed size, one for each kind of the phrases (kind, m, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array(b.column("m").to_pylist(), np.int64)
            for m in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == m))
                at = (_phrase_hash(_codes(part.column("key"), m)) % np.uint64(bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(at + 1)], names=["kind", "at"])  # buckets begin at 1

    at = marked.select("kind", "m", "key").mapInArrow(run, "kind string, at long")
    cells = at.groupBy("kind", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = {k: np.zeros(max(1 << 12, bits // 8), np.uint8) for k in ("known", "open", "grow", "count", "around")}
    for r in cells.toLocalIterator():  # at most bits / 32768 rows of 4096 bytes for each kind
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["kind"]][(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(part)] |= part
    return out


def _read(docs: DataFrame, salt: int, sent: Broadcast, bits: int) -> DataFrame:
    """(key, n, least and greatest words around): one reading of the corpus; a phrase is counted whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = sent.value
        counts = {m: _Tally(m, 1) for m in range(2, LONGEST + 1)}
        around = {m: _Tally(m, 4) for m in range(2, LONGEST)}

        def met(kind: str, h: np.ndarray) -> np.ndarray:
            if kind not in arrays:
                return np.zeros(len(h), bool)
            at = h % np.uint64(bits)
            return (arrays[kind][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for b in Coder(salt).batches(_rows(batches)):
            hashes = []
            for m, here, h in b.windows():
                hashes.append(h)
                if m == 1:
                    continue
                at = np.flatnonzero(here)
                end, before = hashes[m - 2], hashes[m - 3] if m > 2 else None
                grows = at[met("grow", end[at])]
                # the right part must be frequent, unless what it grew from has not grown itself
                right = end[grows + 1]
                fit = met("known", right)
                if before is not None:
                    fit |= met("open", before[grows + 1])
                grows = grows[fit]
                if "count" in arrays:
                    grows = np.union1d(grows, at[met("count", h[at])])
                codes = b.phrases(grows, m)
                counts[m].add(h[grows], codes, np.ones(len(grows), np.int64))
                if m < LONGEST and "around" in arrays:
                    seen = at[met("around", h[at])]
                    left, right = b.around(seen, m)
                    around[m].add(h[seen], b.phrases(seen, m), left, left, right, right)
            for tally in (*counts.values(), *around.values()):
                if tally.size > 2 * ENTRIES:
                    tally.shrink()
                if tally.size > ENTRIES:
                    yield tally.rows()
        for tally in (*counts.values(), *around.values()):
            if tally.size:
                yield tally.rows()

    found = _texts(docs).mapInArrow(run, "key binary, n long, left_least long, left_most long, right_least long, right_most long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), *(f(c).alias(c) for c, f in zip(_FOUND[2:], (F.min, F.max, F.min, F.max), strict=True)))


def _div(top: Column, bottom: Column) -> Column:
    return F.call_function("div", top, bottom)


def _whole(c: str, digits: int = 18) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def _head(key: str, words: Column | int) -> Column:
    return F.substring(F.col(key), F.lit(1), (F.lit(words) if isinstance(words, int) else words) * 8)


def _scored(state: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, score, l, r) of phrases that have all parts counted, and (key, best, missing parts) of the others.

    best is what the phrase can score at most, with no count known for a missing right part.
    """
    open_ = state.where("score is null and m > 1").select("key", "m", "lang", F.col("n").alias("a"))
    cuts = open_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.withColumn("left", _head("key", F.col("k"))).withColumn("right", F.substring(F.col("key"), F.col("k") * 8 + 1, (F.col("m") - F.col("k")) * 8))
    counts = state.select(F.col("key").alias("part"), F.col("n").alias("f"))
    met = cuts.join(counts.withColumnsRenamed({"part": "left", "f": "l"}), "left", "left").join(counts.withColumnsRenamed({"part": "right", "f": "r"}), "right", "left")
    met = met.join(totals, "lang")
    top = F.lit(1000).cast("decimal(4,0)") * (_whole("a", 16) * _whole("total", 16))
    # a part occurs at least as often as the whole
    cut = _div(top.cast("decimal(38,0)"), (F.coalesce("l", "a").cast("decimal(18,0)") * F.coalesce("r", "a").cast("decimal(18,0)")).cast("decimal(38,0)"))
    met = met.withColumn("cut", cut)
    gone = F.array_distinct(F.flatten(F.collect_list(F.filter(F.array(F.when(F.col("l").isNull(), F.col("left")), F.when(F.col("r").isNull(), F.col("right"))), lambda x: x.isNotNull()))))
    per = met.groupBy("key", "lang").agg(F.min(F.struct("cut", "k", "l", "r")).alias("least"), gone.alias("gone"))
    done = per.where(F.size("gone") == 0).select("key", F.col("least.cut").alias("score"), F.col("least.l").alias("l"), F.col("least.r").alias("r"))
    return done, per.where(F.size("gone") > 0).select("key", "lang", F.col("least.cut").alias("best"), "gone")


def _settled(state: DataFrame, top: int) -> DataFrame:
    """(lang, last): the score that a phrase must reach, where a language has `top` phrases that stay."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    ranked = state.where("score is not null and not fixed").select("lang", "score", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= top).groupBy("lang").agg(F.min("score").alias("last"), F.count("*").alias("found")).where(F.col("found") == top).drop("found")


def _best(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The rows of each language with the best values, ties included."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc(by)))).where(F.col("rank") <= most).drop("rank")


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The words of all languages with their codes, and the salt that tells them apart."""
    for salt in range(1, 10):
        path = scratch(docs.sparkSession, "words")
        words = written(_words(docs, salt), "words", path)
        if words.groupBy("code").count().where("count > 1").isEmpty():
            return words, salt
        removed(docs.sparkSession, path)
    raise RuntimeError("words of the corpus keep sharing their codes")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, step: int = STEP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language of docs (text, lang).

    Texts are in lower case by A to Z alone and cut into pieces at `.,;:!?` and line breaks, pieces into words at blanks
    and tabs. A phrase has 2 to 5 words of a piece and occurs a >= `least` times; n is the number of words of its language,
    l and r count the parts of its weakest cut (of equal ones the first). A phrase that always stands in the same longer
    one is left out. Ties go to the larger a, then to the smaller phrase in UTF-8. A null text counts as empty, a null
    language as 'und', repeated rows count again; other columns are not looked at. A language may have no row.
    """
    spark = docs.sparkSession
    words, salt = vocabulary(docs)
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    code = words.where(F.col("n") >= least).mapInArrow(_coded, "lang string, key binary, n long")
    bound = _div(F.lit(1000).cast("decimal(4,0)") * _whole("total"), _whole("first"))
    none = {"score": F.lit(None).cast("long"), "l": F.lit(None).cast("long"), "r": F.lit(None).cast("long"), "fixed": F.lit(None).cast("boolean")}
    first = code.join(totals, "lang").withColumn("first", F.col("n")).withColumn("bound", bound)
    first = first.select("key", F.lit(1).alias("m"), "lang", "n", "first", "bound", F.lit(False).alias("grown"), *(v.alias(k) for k, v in none.items()))
    at = scratch(spark, "state")
    state = written(first, "state", at)
    size = step
    while True:
        last = written(_settled(state, top), "last")
        floor = F.coalesce("last", F.lit(-1))
        done, missing = _scored(state, totals)
        known = state.join(last, "lang", "left")
        grow = _best(known.where(~F.col("grown") & (F.col("m") < LONGEST) & (F.col("bound") >= floor)).select("lang", "key", "m", "bound"), "bound", size)
        grow = written(grow.select("key", "m"), "grow")
        around = _best(known.where(F.col("fixed").isNull() & (F.col("score") >= floor)).select("lang", "key", "m", "score"), "score", 2 * top)
        count = missing.join(last, "lang", "left").where(F.col("best") >= floor).select(F.explode("gone").alias("key")).distinct()
        work = [("grow", grow), ("around", around.select("key", "m")), ("count", count.select("key", (F.length("key") / 8).cast("int").alias("m")))]
        work = written(_union(work), "work")
        if work.isEmpty():
            break
        marks = [("known", state), ("open", state.where(~F.col("grown") & (F.col("m") < LONGEST)))]
        filters = _filters(work.unionByName(_union(marks)), bits)
        sent = spark.sparkContext.broadcast({k: v for k, v in filters.items() if v.any()})
        found = written(_read(docs, salt, sent, bits).where((F.col("n") >= least) | F.col("left_least").isNotNull()), "found")
        sent.destroy()  # the filters of past rounds would stay with the driver
        # what has grown, what is around
        alone = lambda side: (F.col(f"{side}_least") == F.col(f"{side}_most")) & (F.col(f"{side}_least") != 0)
        seen = found.where("left_least is not null").select("key", (alone("left") | alone("right")).alias("now"))
        old = state.join(grow.select("key", F.lit(True).alias("grew")), "key", "left").join(seen, "key", "left")
        old = old.withColumn("grown", F.col("grown") | F.coalesce("grew", F.lit(False))).withColumn("fixed", F.coalesce("fixed", "now")).drop("grew", "now")
        lead = state.where("m = 1").select(F.col("key").alias("head"), "lang", "first", "bound")
        new = found.where(F.col("n") >= least).select("key", "n", (F.length("key") / 8).cast("int").alias("m"), _head("key", 1).alias("head"))
        new = new.join(state.select("key"), "key", "left_anti").join(lead, "head")
        fixed = F.when(F.col("m") == LONGEST, F.lit(False)).alias("fixed")  # nothing is longer
        new = new.select("key", "m", "lang", "n", "first", "bound", F.lit(False).alias("grown"), *(v.alias(k) for k, v in none.items() if k != "fixed"), fixed)
        merged_at, new_at = scratch(spark, "merged"), scratch(spark, "state")
        merged = written(old.unionByName(new), "merged", merged_at)
        done, _ = _scored(merged, totals)
        fresh = done.select("key", *(F.col(c).alias(f"new_{c}") for c in ("score", "l", "r")))
        merged = merged.join(fresh, "key", "left")
        for c in ("score", "l", "r"):
            merged = merged.withColumn(c, F.coalesce(c, f"new_{c}")).drop(f"new_{c}")
        state = written(merged, "state", new_at)
        removed(spark, at, merged_at)  # the new table holds all that later rounds read
        at, size = new_at, size * 4
    # of each language what reaches its last score, with its words
    kept = state.join(last, "lang", "left").where(~F.col("fixed") & (F.col("score") >= floor)).select("key", "m", "lang", "n", "l", "r", "score")
    places = kept.select("key", "lang", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("at")).withColumn("word_key", F.substring(F.col("key"), F.col("at") * 8 + 1, F.lit(8)))
    names = words.where(F.col("n") >= least).mapInArrow(_named, "word_key binary, word string")
    spelled = places.join(names, "word_key").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.join(spelled, "key").join(totals, "lang").withColumnRenamed("n", "a").withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("kind"), "key", "m")
        out = rows if out is None else out.unionByName(rows)
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = np.asarray(b.column("code")).view(np.uint64).reshape(-1, 1)
        yield pa.RecordBatch.from_arrays([b.column("lang"), _keys(codes), b.column("n")], names=["lang", "key", "n"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = np.asarray(b.column("code")).view(np.uint64).reshape(-1, 1)
        yield pa.RecordBatch.from_arrays([_keys(codes), b.column("word")], names=["word_key", "word"])
