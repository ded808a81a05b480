"""Benchmark decontamination by template canonicalisation.

Numbers and units become typed placeholders, in a second form names too, and in a third one also the capitalised words
that open a sentence, which may be names or not. Windows of canonical words of documents
and benchmark items are joined by hash. Matches of one document and item are grouped by alignment; an alignment counts
if its slots are consistent, that is if each of the item's slot values always stands against the same value in the
document. A document that covers enough of an item's windows holds the item, possibly with other numbers and names.
Items without any window that has enough literal words are compared by windows of their words and slot values.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import written

WINDOW = 8
#: An item counts as held from this share of its windows.
COVERAGE = 0.5
#: Literal words that a window must have beside its placeholders.
LITERALS = 4
#: Benchmark words sent to the tasks as a filter, and windows sent as a join side; beyond these, neither is sent.
WORDS_SENT, WINDOWS_SENT = 1_000_000, 1_000_000
# Names of units, and titles that precede a name.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles inch inches foot feet degree degrees mph kmh hz khz mhz ghz w kw v kb mb gb tb"
TITLES = "mr mrs ms miss dr prof sir madam herr frau monsieur madame señor señora"
_UNITS, _TITLES = frozenset(UNITS.split()), frozenset(TITLES.split())
# Letters of scripts without spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Han, Yi) are words of their own.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aad\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uf900-\ufaff\uff66-\uff9d\U0001b000-\U0001b16f\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[^\W\d_{_UNSPACED}]+|(?=[^\W\d_])[{_UNSPACED}]|[.!?%$€£]")
_END, _SIGN = frozenset(".!?"), frozenset("%$€£")
NUM, UNIT, NAME = 1, 2, 3
#: The form of windows that are compared by all their words and values.
EXACT = 3
#: Stands before each stretch where stretches are read together: an unknown word that ends a sentence.
BORDER = "\ufdd0\ufdd1"
#: Kinds of pieces, in the low bits of their codes; PARTS has more than one word, NONE has none. ENDS: a sentence ends here.
WORD, CAPITAL, NUMBER, UNITWORD, TITLE, SIGN, NONE, PARTS = range(8)
ENDS = 8
_CUT, _AFTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CUT[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_AFTER[list(b".,;:!?")] = True
_OTHER[[*range(97, 123), 0xC3, *range(0x9F, 0xC0)]] = False
SCHEMA = "id long, form int, pos int, n int, hash long, slots array<string>"


def parts_of(piece: str) -> list[str]:
    """Words, numbers and marks of a piece between white space; signs only beside a number."""
    toks = _TOKEN.findall(piece)
    return toks if any(t[0].isdigit() for t in toks) else [t for t in toks if t not in _SIGN]


class Canon:
    """Words of a text as numbers; with a filter, words outside it are 0."""

    def __init__(self, only: frozenset[str] | None = None, entries: int = 250_000):
        self.only, self.entries, self.known = only, entries, {BORDER: ENDS}

    def _code(self, tok: str) -> int:
        low = tok.lower()
        if tok in _SIGN:
            kind = SIGN
        elif tok[0].isdigit():
            kind = NUMBER
        elif low in _UNITS:
            kind = UNITWORD
        elif low in _TITLES:
            kind = TITLE
        else:
            kind = CAPITAL if tok[0].isupper() and not (len(tok) > 1 and tok.isupper()) else WORD
        code = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 3) >> 12 << 4 if self.only is None or low in self.only else 0
        return code | kind

    def _parts(self, piece: str) -> list[int]:
        out: list[int] = []
        for t in parts_of(piece):
            if t not in _END:
                out.append(self._code(t))
            elif out:
                out[-1] |= ENDS
        return out

    def _piece(self, piece: str) -> int:
        own = self._parts(piece)
        return own[0] if len(own) == 1 else PARTS if own else NONE | (ENDS if any(c in _END for c in piece) else 0)

    def _read(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces with a word, their codes with kinds, and which open a sentence."""
        pieces = (text or "").split()
        got = list(map(self.known.get, pieces))
        if None in got:
            if len(self.known) > self.entries:
                self.known = dict(islice(self.known.items(), self.entries // 4))
            for k, g in enumerate(got):
                if g is None:
                    p = pieces[k]
                    got[k] = self.known.get(p)
                    if got[k] is None:
                        got[k] = self._piece(p)
                        if len(p) <= 40:
                            self.known[p] = got[k]
        raw = np.array(got, np.int64)
        if (raw == PARTS).any():
            whole = [(w, c) for p, g in zip(pieces, got, strict=True) for w, c in (zip([t for t in parts_of(p) if t not in _END], self._parts(p), strict=True) if g == PARTS else ((p, g),))]
            pieces, raw = [w for w, _ in whole], np.array([c for _, c in whole], np.int64)
        ends = (raw & ENDS) != 0
        kind = raw & 7
        opens = np.concatenate(([True], ends[:-1]))[: len(raw)]
        if (none := kind == NONE).any():
            # a mark on its own ends the sentence for the next word
            real = np.flatnonzero(~none)
            pieces, raw, kind, opens = [pieces[k] for k in real], raw[real], kind[real], opens[real]
        return pieces, raw, opens

    def values(self, text: str | None) -> np.ndarray:
        """Codes that keep every number, unit and name: 0 unknown or a hash."""
        return self._read(text)[1] & ~np.int64(15)

    def forms(self, text: str | None) -> tuple[list[str], list[np.ndarray]]:
        """The pieces with a word, and for each form their codes: 0 unknown, NUM, UNIT, NAME or a hash."""
        pieces, raw, opens = self._read(text)
        kind, code = raw & 7, raw & ~np.int64(15)
        number = kind == NUMBER
        if number.any() or (kind == SIGN).any():
            code = np.where(number, NUM, code)
            after = np.concatenate(([False], number[:-1]))
            code = np.where((kind == UNITWORD) & after | (kind == SIGN), UNIT, code)
        named = (kind == CAPITAL) & ~opens
        if (title := kind == TITLE).any():
            named |= (kind == CAPITAL) & np.concatenate(([False], title[:-1]))
        capital = kind == CAPITAL
        return pieces, [code, np.where(named, NAME, code), np.where(capital, NAME, code)] if capital.any() else [code]


class Sieve:
    """Finds the stretches of texts that may hold a window: enough pieces one after another that are not plain words
    unknown to the benchmark. A plain word is of lower-case Latin letters, with marks after it at most."""

    def __init__(self, words: frozenset[str], least: int):
        self.least = least
        self.multiplier, self.room = 0x9E3779B97F4A7C15, 0
        self._powers(1 << 20)
        self.known = np.unique(np.array([self._hash(w.encode("utf-8", "surrogatepass")) for w in words | _UNITS], np.uint64))

    def _powers(self, n: int) -> None:
        if n > self.room:
            self.room = n
            self.power, self.inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, m, np.uint64)))) for m in (self.multiplier, pow(self.multiplier, -1, 1 << 64)))

    def _hash(self, word: bytes) -> int:
        return int(((np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)) * self.power[: len(word)]).sum())

    def stretches(self, texts: list[bytes]) -> list[list[tuple[int, str]]]:
        """For each text (number of the first piece, stretch); one piece more on the left, which may end a sentence."""
        raw = b" \x7f ".join(texts) + b" \x7f"  # one piece between texts, which ends every stretch
        buf = np.frombuffer(raw, np.uint8)
        self._powers(len(buf))
        upper = _UPPER[buf]
        cut = np.flatnonzero(_CUT[buf])
        start, stop = np.concatenate(([0], cut + 1)), np.append(cut, len(buf))
        some = stop > start
        start, stop = start[some], stop[some]
        ends = np.searchsorted(start, np.cumsum([len(t) + 3 for t in texts]) - 2)  # the pieces between texts
        end = stop.copy()
        for _ in range(2):  # marks after a word
            end -= (end - start > 1) & _AFTER[buf[end - 1]]
        other = _OTHER[buf]
        wide = np.flatnonzero(buf[:-1] == 0xC3)
        after = buf[wide + 1]
        other[wide] = (after < 0x9F) | (after == 0xB7)
        other = np.concatenate(([0], np.cumsum(other)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(((buf + 32 * upper).astype(np.uint64) + np.uint64(1)) * self.power[: len(buf)])))
        h = (sums[end] - sums[start]) * self.inverse[start]
        capital = upper[start]
        odd = other[end] - other[start] > capital  # may be several words, or one with another lower-case form
        literal = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h if len(self.known) else odd
        maybe = odd | capital | literal
        maybe[ends] = False
        gaps = np.concatenate(([-1], np.flatnonzero(~maybe), [len(maybe)]))
        runs = np.flatnonzero(np.diff(gaps) > 1)
        lo, hi = gaps[runs] + 1, gaps[runs + 1]
        # an odd piece counts with all its bytes
        most = np.where(odd, stop - start, 1)
        size, found = (np.concatenate(([0], np.cumsum(x))) for x in (most, most * (odd | literal)))
        need = min(LITERALS, self.least)
        long = (size[hi] - size[lo] >= self.least) & (found[hi] - found[lo] >= need)
        # a window spans at most `least` pieces, and one more for each piece without a word, which counts as found
        good = np.concatenate(([0], np.cumsum(found[self.least :] - found[: -self.least] >= need))) if len(found) > self.least else np.zeros(1, np.int64)
        wide = hi - lo >= self.least
        long[wide] &= good[hi[wide] - self.least + 1] > good[lo[wide]]
        lo, hi = lo[long], hi[long]
        of = np.searchsorted(ends, lo)
        base = np.concatenate(([0], ends[:-1] + 1))
        lo = np.maximum(lo - 1, base[of])
        out: list[list[tuple[int, str]]] = [[] for _ in texts]
        for k, first, x, y in zip(of.tolist(), (lo - base[of]).tolist(), start[lo].tolist(), stop[hi - 1].tolist(), strict=True):
            out[k].append((first, raw[x:y].decode("utf-8", "surrogatepass")))
        return out


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Of all windows of n codes."""
    size = len(codes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + size].astype(np.uint64) + np.uint64(1)
    return total


def _among(total: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    h = total.view(np.int64)
    return wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h


def exact_windows(doc: int | None, codes: np.ndarray, sizes: list[int], wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """Like windows(), of the codes of values(): all windows without an unknown word, none has slots."""
    known = np.concatenate(([0], np.cumsum(codes != 0)))
    for n in sizes:
        if not 0 < n <= len(codes):
            continue
        total = _hashes(codes, n)
        good = known[n:] - known[:-n] == n
        if wanted is not None and good.any():
            good &= _among(total, wanted)
        for p in np.flatnonzero(good).tolist():
            yield doc, EXACT, p, n, int(total[p : p + 1].view(np.int64)[0]), []


def windows(doc: int | None, pieces: list[str], forms: list[np.ndarray], sizes: list[int], wanted: np.ndarray | None = None) -> Iterator[tuple]:
    """(id, form, pos, n, hash, slots): windows with enough literal words and no unknown one. Forms 1 and 2 only where they differ from the one before.

    `wanted`: sorted hashes, others are left out.
    """
    for form, codes in enumerate(forms):
        gaps = np.concatenate(([-1], np.flatnonzero(codes == 0), [len(codes)]))
        lo_hi = gaps[:-1] + 1, gaps[1:]
        fits = np.diff(gaps) > min(sizes)
        # a run needs literal words for one window, and in a later form a further name
        for marks, least in ((codes > NAME, min(LITERALS, min(sizes))), (codes != forms[form - 1] if form else None, 1)):
            if marks is not None:
                total = np.concatenate(([0], np.cumsum(marks)))
                fits &= total[lo_hi[1]] - total[lo_hi[0]] >= least
        runs = np.flatnonzero(fits)
        for r in runs.tolist():
            lo, hi = int(gaps[r]) + 1, int(gaps[r + 1])
            own = codes[lo:hi]
            slot = own <= NAME
            for n in sizes:
                size = hi - lo - n + 1
                if size < 1:
                    continue
                total = _hashes(own, n)
                filled = np.concatenate(([0], np.cumsum(slot)))
                slots = filled[n:] - filled[:-n]
                good = n - slots >= min(LITERALS, n)
                if form:
                    new = np.concatenate(([0], np.cumsum(own != forms[form - 1][lo:hi])))
                    good &= new[n:] > new[:-n]  # without a further name it is a window of the form before
                if wanted is not None and good.any():
                    good &= _among(total, wanted)
                for p in np.flatnonzero(good).tolist():
                    words = ["".join(parts_of(pieces[lo + k])).lower().rstrip(".!?") for k in np.flatnonzero(slot[p : p + n]) + p] if slots[p] else []
                    yield doc, form, lo + p, n, int(total[p : p + 1].view(np.int64)[0]), words


def _parts(b: pa.RecordBatch, sieve: Sieve | None) -> Iterator[list[tuple[int | None, int, str | None]]]:
    """Lists of (id, number of the first piece, text): a whole text, or what the sieve leaves of about 1 MB of texts."""
    ids = b.column(0).to_pylist()
    if sieve is None:
        yield from ([(doc, 0, t.as_py())] for doc, t in zip(ids, b.column(1), strict=True))
        return
    own, texts, size = [], [], 0
    for k, t in enumerate(b.column(1)):
        texts.append((t.as_py() or "").encode())
        own.append(ids[k])
        size += len(texts[-1])
        if size > 1 << 20 or k + 1 == len(ids):
            yield [(doc, first, part) for doc, parts in zip(own, sieve.stretches(texts), strict=True) for first, part in parts]
            own, texts, size = [], [], 0


def _found(canon: Canon, parts: list[tuple[int | None, int, str | None]], sizes: list[int], exact: list[int] | None, hashes: np.ndarray | None) -> Iterator[tuple]:
    """Windows of several stretches, read as one text with a border before each."""
    if len(parts) > 1 and any(BORDER in t for _, _, t in parts):
        for one in parts:
            yield from _found(canon, [one], sizes, exact, hashes)
        return
    if not parts:
        return
    text = parts[0][2] if len(parts) == 1 else "".join(f" {BORDER} {t}" for _, _, t in parts)
    pieces, forms = canon.forms(text)
    found = windows(None, pieces, forms, sizes, hashes) if sizes else iter(())
    if exact:
        found = chain(found, exact_windows(None, canon.values(text), exact, hashes))
    if len(parts) == 1:
        doc, first, _ = parts[0]
        yield from ((doc, row[1], row[2] + first, *row[3:]) for row in found)
        return
    border = [k for k, p in enumerate(pieces) if p == BORDER]
    for row in found:
        k = bisect_right(border, row[2]) - 1
        doc, first, _ = parts[k]
        yield doc, row[1], row[2] - border[k] - 1 + first, *row[3:]


def template_windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], only=None, wanted=None, exact: list[int] | None = None) -> DataFrame:
    """Rows of SCHEMA for every whole text; `only` and `wanted` are broadcast: the words and the sorted hashes that can match.

    `exact`: sizes of exact windows that are wanted besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(only.value if only is not None else None)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        hashes = wanted.value if wanted is not None else None
        sieve = Sieve(only.value, min([*sizes, *(exact or [])])) if only is not None else None
        rows: list[tuple] = []
        for b in batches:
            for parts in _parts(b, sieve):
                for row in _found(canon, parts, sizes, exact, hashes):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _spans(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Exact windows of items, of the usual size or that of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            rows = []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = canon.values(t)
                rows += exact_windows(item, codes, [min(window, len(codes))])
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "form", "pos", "n", "hash", "slots"), r, strict=True)) for r in rows], schema=pa.schema([("id", pa.int64()), ("form", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))]))

    return items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _item_words(items: DataFrame, text_col: str) -> DataFrame:
    """Distinct lower-case words and numbers of the benchmark, and the number of words of each item."""

    def run(batches):
        for b in batches:
            for t in b.column(0):
                toks = [w for p in (t.as_py() or "").split() for w in parts_of(p) if w not in _END]
                words = sorted({w.lower() for w in toks})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([len(toks)] * len(words), pa.int32())], names=["word", "n"])

    return items.select(text_col).mapInArrow(run, "word string, n int")


def held_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(id, item, coverage, n_windows, verbatim): documents that hold a benchmark item, one row for each pair.

    An item shorter than a window is one window of its own length, if it has words enough. An item of which no window
    has enough literal words (tables of numbers, one to three words) is held where its words and values stand. Null and empty texts and
    items match nothing. Rows that share an id count as one document, rows without an id as one too. `verbatim` is
    true where all slot values are equal as well.
    """
    spark = docs.sparkSession
    seen = written(_item_words(items, item_text).groupBy("word").agg(F.min("n").alias("least")), "benchmark-words")
    least = seen.agg(F.min("least")).first()[0]
    sizes = sorted({window} | set(range(max(LITERALS, least or window), window)))
    many = seen.count()
    only = spark.sparkContext.broadcast(frozenset(r["word"] for r in seen.select("word").collect())) if many <= WORDS_SENT else None
    whole = written(template_windows(items, item_col, item_text, sizes), "item-windows")
    bare = items.join(whole.select(F.col("id").alias(item_col)).distinct(), item_col, "left_anti").where(F.col(item_col).isNotNull())
    spans = written(_spans(bare, item_col, item_text, window), "item-spans")
    exact = sorted(r["n"] for r in spans.select("n").distinct().collect())
    whole = whole.unionByName(spans)
    # an item is compared by windows of the usual size, or by one that spans it
    top = whole.groupBy("id").agg(F.max("n").alias("top"))
    bench = whole.join(top, "id").where("n = top").select(F.col("id").alias("item"), F.col("form").alias("item_form"), F.col("pos").alias("item_pos"), "n", "hash", F.col("slots").alias("item_slots"))
    bench = written(bench, "benchmark-windows")
    bench_side, wanted = bench, None
    if 0 < bench.count() <= WINDOWS_SENT:
        bench_side = F.broadcast(bench)
        wanted = spark.sparkContext.broadcast(np.unique(np.array([r["hash"] for r in bench.select("hash").distinct().collect()], np.int64)))
    of_item = bench.groupBy("item").agg(F.countDistinct("item_pos").alias("of"))
    met = template_windows(docs, id_col, text_col, sizes, only, wanted, exact).join(bench_side, ["n", "hash"])
    # a name may open a sentence on one side only, so the forms need not be equal. Opening words need not be names:
    # an alignment counts if it is consistent with them (level 1) or without them (level 0)
    levels = F.when(F.greatest("form", "item_form") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = met.withColumn("pairs", F.arrays_zip("item_slots", "slots")).withColumn("level", F.explode(levels))
    line = met.groupBy("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "level").agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    one_to_one = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item_slots"]))) == F.size("pairs")
    line = line.where(one_to_one).withColumn("same", F.forall("pairs", lambda x: x["item_slots"] == x["slots"]))
    held = line.groupBy("id", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), F.max("same").alias("verbatim"))
    best = held.join(of_item, "item").withColumn("coverage", F.col("n_windows") / F.col("of")).where(F.col("coverage") >= coverage)
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("coverage", 6).alias("coverage"), "n_windows", "verbatim")
