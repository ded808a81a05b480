"""Toxicity by class-conditional Kneser-Ney models over the letters of a text.

A text is read as lower-case letters, with one blank for each run of anything else, so that n-grams run across words
and expressions of several words count as such. Each class has its own counts for n-grams of three to five symbols; both
back off to continuation counts of one and two symbols that they share. All labelled rows are counted, and Spark derives
from the counts, for every n-gram seen, the difference of the two smoothed log-probabilities, and for every context the
difference of the two back-off weights. A document's score is a logistic function of its length-normalised difference,
of its strongest words and of how many words stand out, fitted on labelled documents that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tapewatch.llm.common import drop_columns, letters, small, union_all, widened, written

ORDER, SHARED, BITS = 5, 2, 12
MASK = (1 << BITS) - 1
DISCOUNT = 0.75
#: Documents of each label that the logistic layer is fitted on, at most about, and their largest share of all.
SAMPLE, SHARE = 2000, 0.25
#: Values of the model that are sent to the tasks, at most; the others are joined with the places of texts that need them.
HELD = 2_000_000
#: Pairs of symbols whose values are sent, at most.
PAIRS_HELD = 1 << 20
#: Labels up to so many rows are sent to the tasks; beyond, texts are joined with them by key.
LABELS_SENT = 3_000_000
#: Evidence above which a word stands out.
STANDS_OUT = (2.0, 3.5, 5.0)
FEATURES = 6 + len(STANDS_OUT)
CHUNK, PENDING, KEPT = 1 << 20, 1 << 21, 1 << 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str | None) -> Iterator[np.ndarray]:
    """Symbols of a whole text in chunks that end with a word: letters below 4096 as they are, others folded into that
    range; 0 for each run of anything else, and at the end."""
    left, letter = np.zeros(0, np.int64), True  # letter: a blank may follow
    for at in range(0, len(text or ""), CHUNK):
        f = letters(text[at : at + CHUNK]).astype(np.int64)
        f = np.concatenate((left, np.where(f > MASK, f % (MASK - 255) + 256, f)))
        f = f[(f > 0) | np.concatenate(([letter], f[:-1] > 0))[: len(f)]]
        last = np.flatnonzero(f == 0)
        cut = int(last[-1]) + 1 if len(last) and at + CHUNK < len(text) else 0 if at + CHUNK < len(text) and len(f) < CHUNK else len(f)
        if cut:
            letter = bool(f[cut - 1])
            yield f[:cut]
        left = f[cut:]
    if len(left):
        yield left


def grams(f: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The n-gram of ORDER symbols that ends at each symbol, as one number; `before`: the ORDER - 1 symbols ahead."""
    f = np.concatenate((before, f))
    n = len(f) - ORDER + 1
    g = np.zeros(n, np.int64)
    for k in range(ORDER):
        g = g << BITS | f[k : k + n]
    return g


def _texts_grams(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, n-grams) of each chunk of a text; a blank is added at the end of a text that ends with a letter."""
    before = np.zeros(ORDER - 1, np.int64)
    last = None
    for f in symbols(text):
        if last is not None:
            yield last, grams(last, before)
            before = np.concatenate((before, last))[-(ORDER - 1) :]
        last = f
    if last is not None:
        if last[-1]:
            last = np.append(last, 0)
        yield last, grams(last, before)


def counts(rows: DataFrame, text_col: str = "text", label_col: str = "y") -> DataFrame:
    """(g, c0, c1): how often each n-gram of ORDER symbols stands in the texts of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        have = [(empty, empty), (empty, empty)]
        wait: list[list[np.ndarray]] = [[], []]
        size = [0, 0]

        def merge(y: int) -> None:
            g, n = np.unique(np.concatenate(wait[y]), return_counts=True)
            keys, at = np.unique(np.concatenate((have[y][0], g)), return_inverse=True)
            have[y] = keys, np.bincount(at, np.concatenate((have[y][1], n)), len(keys)).astype(np.int64)
            wait[y], size[y] = [], 0

        def rows_of(y: int) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(have[y][0]), 100_000):
                g, n = (x[k : k + 100_000] for x in have[y])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), y, np.int32)), pa.array(g), pa.array(n)], names=["y", "g", "n"])
            have[y] = empty, empty

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for _, g in _texts_grams(t.as_py()):
                    wait[y].append(g)
                    size[y] += len(g)
                    if size[y] > PENDING:
                        merge(y)
                        if len(have[y][0]) > KEPT:
                            yield from rows_of(y)
        for y in (0, 1):
            if wait[y]:
                merge(y)
            yield from rows_of(y)

    found = rows.select(text_col, F.col(label_col).cast("int").alias("y")).mapInArrow(run, "y int, g long, n long")
    return found.groupBy("g").agg(*(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"c{y}") for y in (0, 1)))


def _shorter(order: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def _contexts(level: DataFrame) -> DataFrame:
    """(h, total0, kinds0, total1, kinds1) of the contexts of a level's n-grams."""
    return level.groupBy(F.shiftright("g", BITS).alias("h")).agg(*(x for c in (0, 1) for x in (F.sum(f"c{c}").alias(f"total{c}"), F.count_if(F.col(f"c{c}") > 0).alias(f"kinds{c}"))))


def levels(top: DataFrame) -> dict[int, DataFrame]:
    """(g, c0, c1) for each order: counts at the top, below it how many symbols precede; shared orders count both classes together."""
    found = {ORDER: top}
    for order in range(ORDER, 1, -1):
        own = found[order]
        if order - 1 > SHARED:
            kinds = [F.count_if(F.col(f"c{c}") > 0).alias(f"c{c}") for c in (0, 1)]
            found[order - 1] = written(own.groupBy(_shorter(order).alias("g")).agg(*kinds), f"grams-{order - 1}")
        else:
            found[order - 1] = written(own.groupBy(_shorter(order).alias("g")).agg(F.count("*").alias("c0")).withColumn("c1", F.col("c0")), f"grams-{order - 1}")
    return found


def smoothed(top: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order above the shared ones ((g, weight, value) of n-grams, (g, weight, value) of contexts).

    The value of an n-gram is ln p1 - ln p0; that of a context is the same difference of the weights with which an
    unseen continuation takes the shorter n-gram's.
    """
    by_order = levels(written(top, "grams"))
    kinds = max(2, by_order[1].count() + 1)
    lower = None
    out = {}
    for order in range(1, ORDER + 1):
        level = by_order[order]
        ctx = written(_contexts(level), f"contexts-{order}")
        rows = level.withColumn("h", F.shiftright("g", BITS)).join(ctx, "h")
        if lower is None:
            rows = rows.withColumn("q0", F.lit(1 / kinds)).withColumn("q1", F.lit(1 / kinds))
        else:
            rows = rows.withColumn("s", _shorter(order)).join(lower.select(F.col("g").alias("s"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "s")

        def p(c: int) -> Column:
            own = F.greatest(F.col(f"c{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"total{c}") + DISCOUNT * F.col(f"kinds{c}") / F.col(f"total{c}") * F.col(f"q{c}")
            return F.when(F.col(f"total{c}") > 0, own).otherwise(F.col(f"q{c}"))

        def rest(c: int) -> Column:
            return F.when(F.col(f"total{c}") > 0, DISCOUNT * F.col(f"kinds{c}") / F.col(f"total{c}")).otherwise(F.lit(1.0))

        lower = written(rows.select("g", "c0", "c1", p(0).alias("p0"), p(1).alias("p1")), f"smoothed-{order}")
        if order > SHARED:
            of_gram = lower.select("g", (F.col("c0") + F.col("c1")).alias("weight"), F.ln(F.col("p1") / F.col("p0")).alias("value"))
            of_context = ctx.select(F.col("h").alias("g"), (F.col("total0") + F.col("total1")).alias("weight"), F.ln(rest(1) / rest(0)).alias("value"))
            out[order] = (of_gram, of_context)
    return out


class Table:
    """Values of n-grams by a hash that no two of them share: one in each slot, those that share a slot with it sorted."""

    def __init__(self, g: np.ndarray, value: np.ndarray):
        h = g.astype(np.int64).view(np.uint64) * _SPREAD  # an odd factor: one to one
        order = np.argsort(h)
        h, value = h[order], value[order].astype(np.float32)
        bits = max(10, (2 * len(h)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), len(h)
        slot = (h >> self.shift).astype(np.int64)
        first = np.diff(slot, prepend=-1) > 0
        self.h, self.value, self.shared = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        self.h[slot[first]], self.value[slot[first]] = h[first], value[first]
        if not len(h) or slot[0] > 0:
            self.h[0] = ~np.uint64(0)  # a hash of zero must not be found in an empty slot
        self.shared[slot[~first]] = True
        self.more, self.mores = h[~first], value[~first]

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seen, value) of n-grams."""
        h = g.view(np.uint64) * _SPREAD
        at = (h >> self.shift).view(np.int64)
        seen, value = self.h[at] == h, self.value[at]
        if len(self.more):
            left = np.flatnonzero(~seen)
            left = left[self.shared[at[left]]]
            k = np.minimum(np.searchsorted(self.more, h[left]), len(self.more) - 1)
            hit = self.more[k] == h[left]
            seen[left[hit]], value[left[hit]] = True, self.mores[k[hit]]
        return seen, value


def table_of(rows: DataFrame) -> Table:
    """Collects (g, value); the caller bounds the rows."""
    got = rows.select("g", F.col("value").cast("float").alias("value")).toArrow()
    return Table(got.column(0).to_numpy(), got.column(1).to_numpy())


_TWO = (1 << (2 * BITS)) - 1


def split(tables: dict[int, tuple[DataFrame, DataFrame]], held: int = HELD) -> tuple[Model, dict[int, tuple[DataFrame, DataFrame]] | None]:
    """The model with at most `held` values, and the values that it does not hold, or None.

    All n-grams and contexts that decide about a symbol hold the two symbols before it, so values are held or not by
    such pairs, those of the most frequent pairs first.
    """
    paired = {
        order: (of_gram.withColumn("pair", F.shiftright("g", BITS).bitwiseAND(F.lit(_TWO))), of_context.withColumn("pair", F.col("g").bitwiseAND(F.lit(_TWO))))
        for order, (of_gram, of_context) in tables.items()
    }
    every = [t for both in paired.values() for t in both]
    if sum(t.count() for t in every) <= held:
        return Model({order: (table_of(a), table_of(b)) for order, (a, b) in tables.items()}), None
    pairs = written(union_all([t.select("pair", "weight") for t in every]).groupBy("pair").agg(F.sum("weight").alias("w"), F.count("*").alias("n")), "pairs")
    first = pairs.orderBy(F.desc("w"), "pair").limit(PAIRS_HELD).toArrow()
    fit = int(np.searchsorted(np.cumsum(first.column("n").to_numpy()), held, "right"))
    w, pair = (int(first.column(c)[fit - 1].as_py()) if fit else -1 for c in ("w", "pair"))
    sent = (F.col("w") > w) | ((F.col("w") == w) & (F.col("pair") <= pair)) if fit else F.lit(False)
    kept = small(pairs.where(sent).select("pair"))
    model = Model({order: (table_of(a.join(kept, "pair", "left_semi")), table_of(b.join(kept, "pair", "left_semi"))) for order, (a, b) in paired.items()})
    at = pairs.where(~sent).select((F.col("pair") + 1).alias("at"))  # buckets begin at 1
    cells = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    model.rest = np.zeros((_TWO + 1) // 8, np.uint8)
    for r in cells.toLocalIterator():  # at most 512 rows of 4096 bytes
        part = np.frombuffer(r["bits"], np.uint8)
        model.rest[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(part)] |= part
    rest = {order: tuple(written(t.join(kept, "pair", "left_anti").select("g", "value"), "rest") for t in both) for order, both in paired.items()}
    return model, rest


def _joined(g: DataFrame, rest: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, d) of n-grams (g) of ORDER symbols, as `Model.differences` finds it, from tables of any size."""
    found = g.withColumn("d", F.lit(0.0))
    for order, (of_gram, of_context) in sorted(rest.items()):
        found = found.withColumn("own", F.col("g").bitwiseAND(F.lit((1 << (BITS * order)) - 1))).withColumn("before", F.shiftright("own", BITS))
        found = found.join(of_gram.select(F.col("g").alias("own"), F.col("value").alias("seen")), "own", "left")
        found = found.join(of_context.select(F.col("g").alias("before"), F.col("value").alias("known")), "before", "left")
        found = found.select("g", F.coalesce("seen", F.col("d") + F.coalesce("known", F.lit(0.0))).alias("d"))
    return found


def completed(rows: DataFrame, shared: Broadcast, rest: dict[int, tuple[DataFrame, DataFrame]] | None, text_col: str) -> DataFrame:
    """rows with a column __more of (word, d): what values that the tasks do not hold add to the words of a text; null if nothing."""
    if rest is None:
        return rows.withColumn("__more", F.lit(None).cast(_MORE))
    rows = written(rows.withColumn("__place", F.monotonically_increasing_id()), "scored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = 0
                for f, g in _texts_grams(t.as_py()):
                    at = np.flatnonzero(shared.value.model.lacks(g))
                    words = max(1, int((f == 0).sum()))  # as features counts them
                    word = n + np.minimum(np.cumsum(f == 0) - (f == 0), words - 1)
                    n += words
                    for k in range(0, len(at), 100_000):
                        own = at[k : k + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), place)), pa.array(word[own]), pa.array(g[own])], names=["__place", "word", "g"])

    places = written(rows.select("__place", F.col(f"`{text_col}`")).mapInArrow(run, "__place long, word long, g long"), "places")
    values = _joined(places.select("g").distinct(), rest)
    words = places.join(values, "g").groupBy("__place", "word").agg(F.sum("d").alias("d"))
    more = words.groupBy("__place").agg(F.collect_list(F.struct("word", "d")).alias("__more"))
    return rows.join(more, "__place", "left").drop("__place")


_MORE = "array<struct<word: bigint, d: double>>"


class Model:
    """Differences of log-probabilities; tables by order: (of n-grams, of contexts)."""

    def __init__(self, tables: dict[int, tuple[Table, Table]]):
        self.tables = tables
        self.rest: np.ndarray | None = None  # a bit for each pair of symbols whose values are not held

    def lacks(self, g: np.ndarray) -> np.ndarray:
        """Whether the values that decide about the last symbol are not held."""
        pair = (g >> BITS) & _TWO
        return (self.rest[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 > 0

    def differences(self, g: np.ndarray) -> np.ndarray:
        """Of each n-gram of ORDER symbols: ln p1 - ln p0 of its last symbol after the others."""
        total = np.zeros(len(g), np.float32)
        for order, (of_gram, of_context) in sorted(self.tables.items()):
            own = g & ((1 << (BITS * order)) - 1)
            seen, value = of_gram.find(own)
            known, rest = of_context.find(own >> BITS)
            total = np.where(seen, value, total + np.where(known, rest, 0))
        return total

    def features(self, text: str | None, more: list[dict] | None = None) -> list[float]:
        """What the logistic layer sees of a text; `more`: what values that are not held add to its words."""
        total = size = n = 0.0
        at, add = np.array([m["word"] for m in more or ()], np.int64), np.array([m["d"] for m in more or ()])
        top, pair, last = np.zeros(0, np.float32), -np.inf, None
        over = np.zeros(len(STANDS_OUT))
        for f, g in _texts_grams(text):
            d = self.differences(g)
            ends = np.flatnonzero(f == 0)
            words = np.add.reduceat(d, np.concatenate(([0], ends[:-1] + 1))) if len(ends) else d.sum(keepdims=True)
            if len(at):
                here = (at >= n) & (at < n + len(words))
                words[at[here] - int(n)] += add[here]
                total += float(add[here].sum())
            total, size, n = total + float(d.sum()), size + len(d), n + len(words)
            over += [(words > t).sum() for t in STANDS_OUT]
            both = words if last is None else np.concatenate(([last], words))
            if len(both) > 1:
                pair = max(pair, float((both[1:] + both[:-1]).max()))
            last = words[-1]
            top = np.sort(np.concatenate((top, np.partition(words, -3)[-3:] if len(words) > 3 else words)))[-3:]
        if not n:
            return [0.0] * FEATURES
        best = [float(top[-min(k, len(top))]) for k in (1, 2, 3)]
        return [total / size, *best, pair if n > 1 else best[0], *np.log1p(over).tolist(), log(n)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised columns: (mean, scale, weights with the bias last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) / 100 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) / 100 * w)
    return mean, scale, w


class Classifier:
    def __init__(self, model: Model | None = None, layer: tuple | None = None, rest: dict[int, tuple[DataFrame, DataFrame]] | None = None):
        self.model, self.layer, self.rest = model, layer, rest

    def score(self, texts: list[str | None], more: list[list[dict] | None] | None = None) -> list[float]:
        if self.layer is None:
            return [0.0] * len(texts)
        mean, scale, w = self.layer
        x = (np.array([self.model.features(*x) for x in zip(texts, more or [None] * len(texts), strict=True)]).reshape(-1, FEATURES) - mean) / scale
        return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", sample: int = SAMPLE, share: float = SHARE, held: int = HELD) -> Classifier:
    """Counts all labelled rows but those drawn for the logistic layer: of each label about `sample`, at most `share`.

    The draw is by a hash of the id. Rows with a null id, text or label are left out; with one label every score is 0.
    A row of docs counts once for each row of labels with its id. Of the model's values, `held` are sent to the tasks;
    where there are more, the others are joined with the places of texts that need them.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Classifier()
    draw = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1_000_000)) / 1e6
    least = {y: min(share, sample / n) for y, n in sizes.items()}
    known = known.withColumn("drawn", draw < F.when(F.col("y") == 1, least[1]).otherwise(least[0]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rest = known.where("not drawn").select("id", "y")
    side = F.broadcast(rest) if sum(sizes.values()) <= LABELS_SENT else rest
    tables = smoothed(counts(texts.join(side, "id"), "text", "y"))
    model, more = split(tables, held)
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(model))  # at most `held` values, each at most 4 slots of 13 bytes, and 2 MB

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.model.features(t.as_py(), m) for t, m in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    # at most about 2 * sample rows: sent to the tasks, and FEATURES numbers of each come back
    picked = texts.join(F.broadcast(known.where("drawn").select("id", "y")), "id")
    schema = picked.select("id", "y").schema.add("x", ArrayType(DoubleType()))
    rows = sorted((r["id"], r["y"], tuple(r["x"])) for r in completed(picked.select("id", "y", "text"), shared, more, "text").mapInArrow(measured, schema).collect())
    if len({r[1] for r in rows}) < 2:
        return Classifier()
    return Classifier(model, logistic(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float)), more)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 for every whole text; a null text counts as empty.

    A column of this name, in upper or lower case, is replaced.
    """
    src = drop_columns(docs, out)
    keep = src.columns
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(classifier.model, classifier.layer))  # of a bounded size, see fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = keep.index(text_col), shared.value
        for b in batches:
            found = own.score(b.column(at).to_pylist(), b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, pa.float64())], names=[*keep, out])

    return completed(src, shared, classifier.rest, text_col).mapInArrow(run, widened(src, **{out: "double"}))
